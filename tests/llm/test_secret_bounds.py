"""Secret scans where sizes used to matter: large alphabets, long names, types and placeholders; linear time."""

import resource
import subprocess
import sys
import time
from pathlib import Path

import pytest

from voltaflow.llm import secrets

ROOT = str(Path(__file__).resolve().parents[2])


def named(text):
    return [text[s:e] for s, e, k in secrets.scan(text)[1] if k == "named"]


def test_large_alphabets_stay_small():
    """A literal of 10,000 different characters, named 8,000 times, in less than a gigabyte."""
    code = """
import resource, sys
resource.setrlimit(resource.RLIMIT_AS, (3 << 30, 3 << 30))
from voltaflow.llm import secrets
a = "".join(chr(0x4E00 + i) for i in range(10000))
for name in ("x17", "token"):
    text = "a = '" + a + "'\\n" + f"{name} = a + a\\n" * 8000
    got = secrets.scan(text)[1]
    assert bool(got) == (name == "token"), name
text = "token = '" + a + "'\\n" + "".join(f"token{i} = token + 'Zx81qPlm{i}'\\n" for i in range(4000))
assert len(secrets.scan(text)[1]) == 4001
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    start = time.perf_counter()
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={"PYTHONPATH": ROOT, "PATH": "/usr/bin:/bin"}, check=True)
    assert int(out.stdout.split()[-1]) < 1_000_000 and time.perf_counter() - start < 30
    assert resource


@pytest.mark.parametrize("n", [10, 120, 124, 140, 500, 5000])
def test_names_of_any_length(n):
    assert named("z" * n + "_pwd = 'Zx81qPlm44'") == ["Zx81qPlm44"]
    assert named("pwd" + " " * n + "= 'Zx81qPlm44'") == ["Zx81qPlm44"]


@pytest.mark.parametrize("n", [10, 60, 70, 500])
def test_types_of_any_length(n):
    for kind in ("Map<{}>", "list[{}]", "{}", "a | " * n + "{}"):
        assert named(f"password: {kind.format('k' * n)} = 'Zx81qPlm44'") == ["Zx81qPlm44"], kind


@pytest.mark.parametrize("n", [2, 244, 260, 3000])
def test_placeholders_of_any_length(n):
    for text in ("your" + "A1b2" * n, "x" * 3 * n, "<" + "Zx81" * n + ">", "${" + "Zx81" * n + "}"):
        assert named(f'pwd = "{text}"') == [], text[:20]
        assert named(f'part = "{text}"\npwd = part + "{text}"') == []
    assert named('pwd = "Zx81qPlm44' + "q7" * n + '"')


def test_time_grows_with_the_text():
    def took(text):
        start = time.perf_counter()
        secrets.scan(text)
        return time.perf_counter() - start

    for grow in ("a:", "a: b[", "a: b<c ", "a" * 50 + ":", " :", "token = token + 'abcDEF12'\n", "x: y | z ", "k='", 'k: "a" + '):
        small, large = (min(took(grow * n) for _ in range(2)) for n in (4000, 16000))
        assert large < 0.4 or large < 9 * small, grow
