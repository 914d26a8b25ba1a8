"""Destinations of the packed exchange."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exchange as X


@pytest.mark.parametrize("n", [1, 2, 7, 211, 3000])
def test_labels_reach_their_partitions(spark, n):
    got = X.labels(n)
    rows = spark.createDataFrame([(k, int(v)) for k, v in enumerate(got)], "k int, v int")
    assert rows.filter(F.pmod(F.hash("v"), F.lit(n)) != F.col("k")).count() == 0
    assert len(np.unique(got)) == n and got.min() == 0
    # the least number of each partition
    every = spark.range(int(got.max()) + 1).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("k")).agg(F.min("v").alias("v"))
    assert {r.k: r.v for r in every.collect()} == dict(enumerate(got.tolist()))


def test_labels_of_many_destinations():
    got = X.labels(300_000)
    assert len(np.unique(got)) == len(got)
