from pyspark.sql import functions as F

from docweft.streaming import conversations, events


def test_history_keeps_the_newest_messages(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, t, "system" if t == 3 else "user", f"m{t}") for t in range(16)] + [(2, 0, "user", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = conversations.history(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("history").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.turn for r in spark.table("history").where("conv_id = 1").orderBy("place").collect()] == list(range(4, 16))


def test_upsert_and_windows(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = events.read(spark, str(tmp_path / "ev"), source.schema)
    events.upsert_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    got = {(r.user_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.user_id, r.e) for r in source.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want
    counts = events.windowed_counts(events.read(spark, str(tmp_path / "ev"), source.schema))
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == source.count()
