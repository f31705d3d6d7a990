from pyspark.sql import functions as F

from perigon.streaming import incremental
from tests.helpers import observations


def test_stream_takes_the_first_good_copy(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[{"id": "a", "latitude": ""}, {"id": "b"}], [{"id": "a"}, {"id": "b"}, {"id": "c", "captive_cultivated": "true"}], [{"id": "a"}, {"id": "d", "taxon_genus_name": "", "scientific_name": "Nepenthaceae"}]]
    for rows in batches:
        observations(spark, rows).withColumn("arrived", F.lit("2024-01-01 00:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    accepted = incremental.accepted_stream(incremental.observation_stream(spark, folder, schema, 1))
    query = accepted.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    got = {(r.id, r.taxon_genus_name) for r in spark.read.parquet(out).collect()}
    assert got == {("a", "Drosera"), ("b", "Drosera"), ("d", "Nepenthes")}
    assert spark.read.parquet(out).count() == 3
