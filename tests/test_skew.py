"""Salted joins of one key with most rows."""

import pytest
from pyspark.sql import functions as F

from chatloom.operators.skew import salted_join


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("ids", ["unique", "null", "same"])
def test_hot_key_is_split(spark, how, ids):
    """A key of 20,000 rows whose ids are unique, null or all one is spread over many salts; the rows are those of a join."""
    row = {"unique": F.col("id"), "null": F.lit(None).cast("long"), "same": F.lit(7)}[ids]
    left = spark.range(0, 30_000, 1, 16).select(F.when(F.col("id") < 20_000, "hot").when(F.col("id") < 21_000, None).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"), row.alias("row"), "id")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(400)]], "key string, v int")
    made = salted_join(left, right, "key", F.col("row"), how)
    plain = left.join(right, "key", how)
    pick = lambda df: sorted(map(repr, df.select("id", "key", "v").collect()))
    assert pick(made) == pick(plain)
    assert "_salt" in made._jdf.queryExecution().optimizedPlan().toString()
    salt = F.pmod(F.xxhash64("row", F.spark_partition_id()), F.lit(64))
    most = left.where("key = 'hot'").groupBy(salt.alias("s")).count().agg(F.max("count")).first()[0]
    assert most < 20_000 / 5
