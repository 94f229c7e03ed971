"""What is small takes few tasks, whatever the number of shuffle partitions."""

from pyspark.sql import functions as F

from lakeloom.llm.common import components


def test_components_of_few_edges_take_few_tasks(spark):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(600).where("id % 10 <> 9").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
        out = components(edges)
        assert {(r["node"], r["root"]) for r in out.collect()} == {(i, i - i % 10) for i in range(600)}
        assert len(out.inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lean_hands_all_through_and_clears_up(monkeypatch):
    import gc

    from lakeloom.llm.common import lean

    cleared = []
    monkeypatch.setattr(gc, "collect", lambda: cleared.append(True))
    assert list(lean(lambda batches: (x + 1 for x in batches))([1, 2])) == [2, 3] and cleared == [True]
