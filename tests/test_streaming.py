"""Labels over a stream: each id once, over restarts and replays, and none that is known from elsewhere."""

from pyspark.sql import functions as F

from veridicta.streaming import scorers

SCHEMA = "sent_id string, sentence string, at timestamp"


def label(d):
    return d.select("sent_id", F.length("sentence").alias("label"))


def add(spark, folder, *rows):
    df = spark.createDataFrame([(i, f"a sentence that is long enough {i}" if t is None else t, None) for i, t in rows], SCHEMA)
    df.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000))).coalesce(1).write.mode("append").parquet(folder)


def written(spark, path):
    return sorted((r["sent_id"], r["batch"]) for r in spark.read.parquet(path).collect())


def test_each_id_once_over_restarts_and_replays(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run(**kw):
        scorers.label_stream(spark.readStream.schema(SCHEMA).parquet(source), label, path, checkpoint, **kw).awaitTermination()

    add(spark, source, ("a", None), ("b", None), ("a", None), ("short", "x"), ("none", ""), ("mark", "<!-- image --> and some words"))
    run()
    assert written(spark, path) == [("a", 0), ("b", 0)]
    add(spark, source, ("b", None), ("c", None))
    run()
    assert written(spark, path) == [("a", 0), ("b", 0), ("c", 1)]
    for p in (tmp_path / "checkpoint" / "commits").glob("*1*"):  # as if the run had ended after writing, before it said so
        p.unlink()
    run()
    assert written(spark, path) == [("a", 0), ("b", 0), ("c", 1)]


def test_known_ids_are_left_out(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, source, ("a", None), ("b", None))
    known = spark.createDataFrame([("a",), ("z",)], "sent_id string")
    scorers.label_stream(spark.readStream.schema(SCHEMA).parquet(source), label, path, str(tmp_path / "c"), known, ("at", "1 hour")).awaitTermination()
    assert written(spark, path) == [("b", 0)]
