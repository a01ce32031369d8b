from pyspark.sql import functions as F

from admitflow.session import read
from admitflow.streaming.ingest import ingest


def test_ingest_routes_each_row_once(spark, sf_dir, tmp_path):
    events = read(spark, sf_dir, "events")
    source = f"{tmp_path}/in"
    rules = {"bad_value": F.col("value") >= 10}
    run = lambda: ingest(spark.readStream.schema(events.schema).parquet(source), rules, ["event_id"], f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/checkpoint").awaitTermination()
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(source)
        run()
    run()
    good, dead = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/dead")
    assert good.count() == events.where("value >= 10").count()
    assert sorted(int(r.payload.split(":")[1].rstrip("}")) for r in dead.collect()) == sorted(r.event_id for r in events.where("not coalesce(value >= 10, false)").collect())
