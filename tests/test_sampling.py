"""Epochs: exact batches, weighted draws by frequency, and offers in which every object has the same chance."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling as S


def ids(spark, n):
    return spark.range(n).select(F.concat(F.lit("p"), "id").alias("patch_id"), (F.col("id") % 5).alias("bin"))


@pytest.mark.parametrize("n", [0, 1, 15, 16, 1000])
def test_batches_are_exact_and_repeatable(spark, n):
    t = ids(spark, n)
    got = [S.epoch_batches(t.repartition(k), "patch_id", 16, epoch).collect() for k, epoch in ((1, 0), (7, 0), (3, 1))]
    as_rows = [sorted((r.draw, r.patch_id, r.batch) for r in g) for g in got]
    assert as_rows[0] == as_rows[1] and (n < 100 or as_rows[0] != as_rows[2])
    for rows in as_rows:
        assert [d for d, _, _ in rows] == list(range(n // 16 * 16)) and all(b == d // 16 for d, _, b in rows)
        assert len({p for _, p, _ in rows}) == len(rows)
    whole = S.epoch_batches(t, "patch_id", 16, drop_last=False).collect()
    assert len(whole) == n and {r.batch for r in whole} == set(range(-(-n // 16)))


def test_numbers_follow_amounts(spark):
    t = ids(spark, 300).withColumn("w", F.col("bin") + 1)
    rows = sorted((r.number, r.w) for r in S.numbered(t, S.draw_key(1, F.col("patch_id")), F.col("w")).collect())
    at = 0
    for number, w in rows:
        assert number == at
        at += w


def test_weighted_draws_by_frequency(spark):
    t = ids(spark, 50)
    got = S.weighted_batches(t, "patch_id", 1 + F.col("bin"), 16, draws=60_000, drop_last=False).collect()
    assert sorted(r.draw for r in got) == list(range(60_000))
    n, total = Counter(r.patch_id for r in got), 10 * (1 + 2 + 3 + 4 + 5)
    for k in range(50):
        want = 60_000 * (1 + k % 5) / total
        assert abs(n[f"p{k}"] - want) < 6 * want**0.5
    again = S.weighted_batches(t.repartition(5), "patch_id", 1 + F.col("bin"), 16, draws=60_000, drop_last=False).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = S.weighted_batches(t, "patch_id", 1 + F.col("bin"), 16, epoch=1)
    assert other.count() == 48 and {r.batch for r in other.collect()} == {0, 1, 2}


def test_weights_of_every_size(spark):
    t = spark.createDataFrame([("a", 1e6), ("b", 1.0), ("c", None), ("d", 0.0)], "patch_id string, w double")
    got = Counter(r.patch_id for r in S.weighted_batches(t, "patch_id", F.col("w"), 1, draws=2000).collect())
    assert got["a"] > 1980 and sum(got.values()) == 2000
    assert S.weighted_batches(t.filter("false"), "patch_id", F.col("w")).count() == 0


def test_every_object_has_the_same_chance(spark):
    takers = ids(spark, 20_000)
    got = S.offers(takers.select("patch_id"), F.col("patch_id"), 40, 3, 0.5).collect()
    per = Counter(r.patch_id for r in got)
    assert abs(len(per) - 10_000) < 300 and set(per.values()) == {1, 2, 3}
    n = Counter(r.number for r in got)
    want = len(got) / 40
    assert set(n) == set(range(40)) and all(abs(v - want) < 6 * want**0.5 for v in n.values())
    # more objects than any table of slots would hold
    many = {r.number for r in S.offers(takers.select("patch_id"), F.col("patch_id"), 10**6, 3, 1.0).collect()}
    assert len(many) > 35_000 and max(many) > 990_000
    assert S.offers(takers.select("patch_id"), F.col("patch_id"), 0, 3, 1.0).count() == 0
