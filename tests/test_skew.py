from pyspark.sql import functions as F

from tessera.operators import skew
from tessera.session import drop_staged, shared_dir, staged


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    left = spark.range(600).select(F.when(F.col("id") < 300, F.lit("hot")).when(F.col("id") < 590, F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("400", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left"):
        assert sorted(map(tuple, skew.skew_join(left, right, ["k"], how).select("k", "id", "v").collect()), key=str) == sorted(map(tuple, left.join(right, ["k"], how).select("k", "id", "v").collect()), key=str)


def test_running_sum(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("g"), "id", F.lit(2).cast("long").alias("v"))
    got = skew.running_sum(df, ["g", "id"], "v", "s", 4, lambda x: staged(x, "t")).orderBy("g", "id").collect()
    assert [r["s"] for r in got] == list(range(2, 202, 2))


def test_staged(spark):
    df = staged(spark.range(3), "t", None)
    assert df.count() == 3 and df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_dir(spark).lstrip("/"))
    assert staged(spark.range(0), "empty").count() == 0
    drop_staged(spark)
    assert staged(spark.range(2), "again").count() == 2
