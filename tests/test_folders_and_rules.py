"""Written folders, metadata and parameter checks by hand."""

import json

from pyspark.sql import functions as F

from voltaflow.operators import reviews, validation
from voltaflow.sources import folders, metadata, storage


def test_numbers_that_json_lacks(spark):
    texts = ['{"a": NaN, "b": [-Infinity, Infinity], "c": "NaN, Infinity", "d\\"NaN": 1}', '{"x": "\\\\", "y": NaN}', "", None, '{"NaN": NaN}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, d string")
    got = [r.o for r in df.select(metadata.finite_json(F.col("d")).alias("o"), "i").orderBy("i").collect()]
    assert [json.loads(g) if g else g for g in got] == [{"a": None, "b": [None, None], "c": "NaN, Infinity", 'd"NaN': 1}, {"x": "\\", "y": None}, "", None, {"NaN": None}]


def test_every_kind_has_all_its_keys(spark):
    df = spark.createDataFrame([('{"fs": 5, "chunk_minutes": 10, "uses_display_filter": true}',), ("{",), (None,)], "d string")
    for kind, (keys, name, files) in metadata.KINDS.items():
        for r in df.select(metadata.compacted(F.col("d"), kind).alias("o")).collect():
            doc = json.loads(r.o)
            assert list(doc) == [k.split(":")[0].split("=")[0] for k in keys.split()] + ["output_files"]
            assert doc["algorithm"] == name and doc["output_files"] == list(files) and doc["notch_filter"] is False and doc["notch_modes"] == []
        assert all(f in metadata.readme_text(kind) for f in files)
    first = json.loads(df.select(metadata.compacted(F.col("d"), "gamma").alias("o")).collect()[0].o)
    assert first["detail_chunk_minutes"] == 10 and first["sampling_frequency_hz"] == 5
    assert json.loads(df.select(metadata.compacted(F.col("d"), "rei").alias("o")).collect()[0].o)["display_filter_used_for_computation"] is True


def test_hfo_folder_of_a_plain_run(spark, tmp_path):
    """Without early events their columns aren't written and their classes count as the plain ones; an unknown window gives no rates."""
    events = spark.createDataFrame([(1, "", "a", "ehfo", None, "spike-eHFO", 2.0), (2, "x", "a", "e-HFO", "deleted", None, None), (3, "y", "b", None, "", "spk hfo", float("nan"))], "ord long, event_id string, channel string, final_model_class string, manual_class string, classification_label string, artifact_score double")
    path = f"{tmp_path}/f"
    folders.export_hfo_folder(spark, path, spark.createDataFrame([("a",), ("b",), ("z",), ("z",)], "channel string"), events, '{"detector_version": "other"}')
    assert storage.names(spark, path) == ["README.txt", "hfo_channel_summary.csv", "hfo_events.csv", "hfo_metadata.json"]
    rows = {r.event_id: r for r in spark.read.option("header", True).csv(f"{path}/hfo_events.csv").collect()}
    assert {k: r.official_class for k, r in rows.items()} == {"hfo_000001": "HFO", "x": "deleted", "y": "spike-HFO"} and rows["hfo_000001"].artifact_probability == "2.0" and rows["y"].artifact_probability is None and rows["y"].final_model_class == "spk hfo"
    summary = spark.read.option("header", True).csv(f"{path}/hfo_channel_summary.csv")
    assert summary.columns == [c for c in folders.HFO_SUMMARY if "ehfo" not in c]
    got = {r.channel: r for r in summary.collect()}
    assert (got["a"].candidate_count, got["a"].deleted_event_count, got["b"].spike_hfo_count, got["z"].candidate_count, got["a"].candidate_rate_per_min) == ("1", "1", "1", "0", "0.0")
    kind, tables, meta = folders.open_folder(spark, path)
    assert kind == "hfo" and tables["events"].count() == 3 and meta["detector_version"] == "other"


def test_parameter_checks_tell_the_first_thing(spark):
    good = {
        "route": "eHFO", "fs": 1000.0, "low": 80.0, "high": 300.0, "sigma": 5.0, "min_ms": 6.0, "max_ms": 100.0, "padding_s": 0.5, "gap_ms": 10.0, "cycles": 4.0, "detectors": ["STE", "MNI", "Hilbert"], "analysis_s": 60.0,
        **{d: {p: 0.5 for p in rules} for d, rules in validation.DETECTOR_RULES.items()},
    }
    cases = [
        ({}, None), ({"low": 0.0}, "band edges"), ({"high": float("nan")}, "band doesn't end"), ({"fs": 999.0}, "sampled below"), ({"route": "pyhfo_pybrain", "high": 600.0}, "ends above 500"), ({"route": "pyhfo_pybrain", "fs": 150.0}, "native rate"),
        ({"route": "pyhfo_pybrain", "fs": 500.0, "high": 500.0}, None), ({"sigma": None}, "threshold"), ({"min_ms": 0.5}, "least duration is under"), ({"max_ms": 6.0}, "isn't above"), ({"cycles": 0.0}, "cycle"), ({"detectors": []}, "no detector"), ({"detectors": None}, "no detector"),
        ({"ste": {}}, "ste rms_window_s"), ({"ste": {}, "detectors": ["mni"]}, None), ({"analysis_s": None}, None), ({"analysis_s": 0.0}, "must be positive"), ({"analysis_s": 0.1}, "greatest duration isn't shorter"), ({"padding_s": 30.0}, "leaves nothing"), ({"analysis_s": 1.5, "hilbert": {"sd_threshold": 1.0, "min_window_s": 2.0, "epoch_len_s": 1.0}}, "hilbert min_window_s"),
    ]
    schema = "i long, route string, fs double, low double, high double, sigma double, min_ms double, max_ms double, padding_s double, gap_ms double, cycles double, detectors array<string>, analysis_s double, ste map<string,double>, mni map<string,double>, hilbert map<string,double>"
    names = [p.split()[0] for p in schema.split(", ")]
    df = spark.createDataFrame([tuple(({"i": i} | good | change)[n] for n in names) for i, (change, _) in enumerate(cases)], schema)
    got = [r.p for r in df.select("i", validation.hfo_problem().alias("p")).orderBy("i").collect()]
    for (change, want), text in zip(cases, got):
        assert (text is None) == (want is None) and (want is None or want in text), (change, text)


def test_review_lists(spark):
    assert reviews.class_options(False) == ["artifact", "HFO", "non-spike HFO", "spike-HFO", "unclassified", "deleted"]
    ids = [r[0] for r in spark.range(3).select(reviews.new_id()).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 32 for i in ids)
