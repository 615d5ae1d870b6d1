from pyspark.sql import functions as F

from tessera.operators import history
from tessera.streaming import state


def test_only_expected_versions_publish(spark):
    rows = [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, None), ("b", 1, 5)]
    got = history.published(spark.createDataFrame(rows, "volume_id string, seq long, expected long"))
    assert sorted((r.volume_id, r.seq, r.version) for r in got.collect() if r.accepted) == [("a", 1, 1), ("a", 3, 2), ("a", 4, 3)]
    assert got.where("not accepted").count() == 2


def test_crop_history_verbs(spark):
    log = [("add", 1), ("add", 2), ("add", 3), ("previous", None), ("previous", None), ("add", 4), ("rebase", None), ("add", 5), ("previous", None), ("next", None), ("next", None)]
    rows = [("h", i, v, o) for i, (v, o) in enumerate(log)]
    kinds = "history_id string, seq long, verb string, op long"
    r = history.crop_histories(spark.createDataFrame(rows, kinds)).first()
    assert (r.ops, r.base, r.cursor, r.active) == ([1, 4, 5], 2, 1, [1, 4, 5])
    r = history.crop_histories(spark.createDataFrame([*rows, ("h", 20, "restore", None), ("h", 21, "node", 2)], kinds)).first()
    assert (r.ops, r.base, r.active) == ([1, 4, 5], 0, [1, 4])
    assert history.crop_histories(spark.createDataFrame([], kinds)).count() == 0


def test_last_staged_row_wins(spark):
    got = history.pending(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "volume_id string, seq long, path string"))
    assert sorted(r.path for r in got.collect()) == ["y", "z"]


def test_edges_of_a_stream_carry_over_batches(spark, tmp_path):
    schema = "owner string, seq long, step long"
    for n, rows in enumerate(([("a", 1, 1), ("a", 2, 1), ("b", 3, 1)], [("a", 4, -1), ("a", 5, -1), ("b", 6, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = state.stream_edges(stream, "owner", "seq", "step").writeStream.format("memory").queryName("edges").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(map(tuple, spark.table("edges").where(F.col("owner") == "a").collect())) == [("a", 1, 1), ("a", 5, 0)]
    assert [tuple(r) for r in spark.table("edges").where(F.col("owner") == "b").collect()] == [("b", 3, 1)]
