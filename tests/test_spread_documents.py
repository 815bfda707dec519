"""Documents made of a small file of keys are read and written by many tasks."""

from pyspark.sql import functions as F

from voltaflow.plans import registry


def test_documents_are_many_tasks(spark):
    for name in ("snk09_projects_round_trip", "src11_read_projects", "snk06_metadata"):
        out = registry.queries()[name](spark, "/root/testdata/sf0.001")
        parts = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) >= 4 and max(r["count"] for r in parts) < 0.5 * sum(r["count"] for r in parts), name


def test_filters_on_documents_stay_behind_the_shuffle(spark):
    """No document is parsed in the scan's task: the filter on what is wrong with it isn't pushed there."""
    out = registry.queries()["snk09_projects_round_trip"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan[plan.index("Repartition 4") :]
