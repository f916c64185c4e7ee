from pyspark.sql import functions as F
from tessera import common


def test_salted_join_is_an_equi_join(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)], "k string, w int")
    hot = common.hot_buckets(left, F.xxhash64("k"))
    assert hot
    for how in ("left", "inner"):
        a, b = common.salted_join(left, right, "k", hot, how), left.join(right, "k", how)
        assert a.columns == b.columns and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def test_no_bucket_is_hot_in_even_data(spark):
    assert common.hot_buckets(spark.range(20_000), F.xxhash64("id")) == []
    assert common.hot_buckets(spark.range(0), F.xxhash64("id")) == []
