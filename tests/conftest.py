import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from voltaflow.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "4"), 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
