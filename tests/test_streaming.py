from pyspark.sql import functions as F

from prefero.operators.mnl import MNL
from prefero.streaming.scoring import score_stream, windowed_shares


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 3:02d}:00:00", float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, at string, x double").withColumn("at", F.col("at").cast("timestamp"))
    df.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    m = MNL(batch, ["a", "b"], {"c": {"b": "uno"}, "x": {"a": "x"}})
    m.from_estimates([0.3, -0.2])
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    shares = windowed_shares(score_stream(stream, m.design, m.results.theta), "at", ["a", "b"])
    q = shares.writeStream.format("memory").queryName("shares").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["window"]["start"]: (r["n"], round(r["share_a"], 12)) for r in spark.table("shares").collect()}
    want = {r["at"]: (r["n"], round(r["s"], 12)) for r in m.predict().groupBy("at").agg(F.count("*").alias("n"), F.avg("p_a").alias("s")).collect()}
    assert got == want and len(got) == 3
