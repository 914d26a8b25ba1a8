"""Epochs over tables of any size: exact permutations, batches, weighted draws and offers, all chances from hashes.

Rows are put in the order of the md5 of seed, epoch and id. Its first RANGE_DIGITS hex digits are a range; the ranges' counts (at most
RANGES rows) give each range's offset, and a row's number is its offset and its rank in its range. So numbers are exact,
a rerun gives the same, and no task sorts more than a range. Sums of weights go the same way.

Defined cases: ids are keys (equal ones are ordered as they come); a null id counts as text 'null'; empty tables give no rows; a
weight below one part in WEIGHT_UNIT counts as one part, a null one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.records import DRAW_WEIGHT, coverage_bin
from tessera.registry import query
from tessera.sources.fixtures import duck, view

RANGE_DIGITS, RANGES = 3, 4096
WEIGHT_UNIT = 1000
CELLS = 4096  #: stretches of the weights' sum that draws and rows meet in, at least


def draw_key(*parts) -> Column:
    """md5 of the parts, joined by colons."""
    return F.md5(F.concat_ws(":", *[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("null")) for p in parts]))


def draw_number(key: Column) -> Column:
    """The first 48 bits of a key."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("long")


def numbered(df: DataFrame, key: Column, amount: Column | None = None, name: str = "number") -> DataFrame:
    """Adds ``number``: how many rows (or how much of ``amount``) lie before the row in the order of ``key``."""
    amount = F.lit(1).cast("long") if amount is None else amount
    d = df.withColumn("__key", key).withColumn("__amount", amount).withColumn("__range", F.substring("__key", 1, RANGE_DIGITS))
    sums = d.groupBy("__range").agg(F.sum("__amount").alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(W.orderBy("__range")) - F.col("__sum")).drop("__sum")  # RANGES rows at most
    inside = F.sum("__amount").over(W.partitionBy("__range").orderBy("__key").rowsBetween(W.unboundedPreceding, -1))
    placed = d.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "__range")
    return placed.withColumn(name, F.col("__before") + F.col("__inside")).drop("__key", "__amount", "__range", "__before", "__inside")


def _batches(drawn: DataFrame, n: int, batch: int, drop_last: bool) -> DataFrame:
    out = drawn.withColumn("batch", F.expr(f"draw DIV {batch}"))
    return out.filter(F.col("draw") < n // batch * batch) if drop_last else out


def epoch_batches(ids: DataFrame, column: str, batch: int = 16, epoch: int = 0, seed: int = 42, drop_last: bool = True) -> DataFrame:
    """(column, draw, batch): every id once, in the epoch's own order; a last batch that is not full is dropped unless told otherwise."""
    return _batches(numbered(ids.select(column), draw_key(seed, epoch, F.col(column)), name="draw"), ids.count(), batch, drop_last)


def weighted_batches(ids: DataFrame, column: str, weight: Column, batch: int = 16, epoch: int = 0, seed: int = 42, draws: int | None = None, drop_last: bool = True) -> DataFrame:
    """(column, draw, batch): draws with replacement, each id's chance in proportion to its weight; as many as there are ids unless told otherwise.

    Ids hold stretches of the line of weights as long as their weights, draws are points on it. Both fall into cells of
    equal length (a stretch into all that it meets), and in a cell each point takes the stretch that began last.
    """
    spark = ids.sparkSession
    units = F.greatest(F.lit(1), F.coalesce(F.round(weight * WEIGHT_UNIT), F.lit(1))).cast("long")
    line = numbered(ids.select(column, units.alias("__w")), draw_key(seed, "line", F.col(column)), F.col("__w"), "start")
    n, total = ids.agg(F.count("*"), F.sum(units)).first()
    n = draws if draws is not None else n
    if not total or not n:
        return ids.select(column).limit(0).withColumn("draw", F.lit(0).cast("long")).withColumn("batch", F.lit(0).cast("long"))
    width = max(1, total // max(CELLS, n // 1000))
    cell = lambda c: F.expr(f"({c}) DIV {width}")
    stretches = line.select(F.col(column).alias("id"), "start", F.explode(F.sequence(cell("start"), cell("start + __w - 1"))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("draw"), F.pmod(draw_number(draw_key(seed, epoch, F.col("id"))), F.lit(total)).alias("at"))
    both = stretches.select("cell", F.col("start").alias("at"), "id", F.lit(None).cast("long").alias("draw")).unionByName(points.select(cell("at").alias("cell"), "at", F.lit(None).cast(ids.schema[column].dataType).alias("id"), "draw"))
    met = both.withColumn("id", F.last("id", ignorenulls=True).over(W.partitionBy("cell").orderBy("at", F.col("draw").isNotNull())))
    return _batches(met.filter("draw IS NOT NULL").select(F.col("id").alias(column), "draw"), n, batch, drop_last)


def offers(takers: DataFrame, key: Column, objects: int, most: int, chance: float, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds to ``takers`` the rows (k, number): with ``chance``, one to ``most`` numbers below ``objects``, each equally likely, independently."""
    t = takers.withColumn("__taker", draw_key(seed, epoch, key)).filter(draw_number(F.col("__taker")) < int(chance * (1 << 48)))
    many = 1 + F.pmod(draw_number(F.md5(F.concat("__taker", F.lit("n")))), F.lit(most))
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    return t.withColumn("number", F.pmod(draw_number(F.md5(F.concat("__taker", F.lit(":"), F.col("k").cast("string")))), F.lit(max(1, objects)))).drop("__taker").filter(F.lit(objects > 0))


# ---- on the fixtures

_HEX = "CAST('0x' || substr({}, 1, 12) AS BIGINT)"


@query("k09_epoch_batches", duck("record", "WITH o AS (SELECT patch_id, row_number() OVER (ORDER BY md5('42:3:' || patch_id)) - 1 AS draw, count(*) OVER () AS n FROM fx_record) SELECT patch_id, draw, draw // 16 AS batch FROM o WHERE draw < n // 16 * 16"))
def k09_batches(spark, sf):
    return epoch_batches(view(spark, sf, "record"), "patch_id", 16, epoch=3)


_DRAWS = (
    f"WITH w AS (SELECT patch_id, CAST(round({DRAW_WEIGHT} * 1000) AS BIGINT) AS w FROM fx_record), l AS (SELECT patch_id, w, sum(w) OVER (ORDER BY md5('42:line:' || patch_id)) - w AS a FROM w), "
    f"t AS (SELECT count(*) AS n, CAST(sum(w) AS BIGINT) AS total FROM w), p AS (SELECT draw, n, {_HEX.format("md5('42:3:' || draw)")} % total AS x FROM t, (SELECT unnest(range(t.n)) AS draw FROM t) d) "
    "SELECT patch_id, draw, draw // 16 AS batch FROM p JOIN l ON p.x >= l.a AND p.x < l.a + l.w WHERE draw < n // 16 * 16"
)


@query("r14_weighted_draws", duck("record", _DRAWS))
def r14_draws(spark, sf):
    """An epoch of weighted draws: patches of higher coverage come up to five times as often."""
    weight = 1 + coverage_bin(F.col("coverage_pct")) / F.lit(4.0) * 4
    return weighted_batches(view(spark, sf, "record"), "patch_id", weight, 16, epoch=3)


_OFFERS = (
    f"WITH t AS (SELECT patch_id, md5('42:3:' || patch_id) AS h FROM fx_record), c AS (SELECT patch_id, h, unnest(range(1 + {_HEX.format("md5(h || 'n')")} % 3)) AS k FROM t WHERE {_HEX.format('h')} < 140737488355328), "
    "o AS (SELECT patch_id AS donor, row_number() OVER (ORDER BY md5('42:objects:' || patch_id)) - 1 AS number, count(*) OVER () AS n FROM fx_record WHERE coverage_pct >= 2) "
    f"SELECT c.patch_id, c.k, o.donor FROM c JOIN o ON o.number = {_HEX.format("md5(h || ':' || c.k)")} % o.n"
)


@query("r20_paste_offers", duck("record", _OFFERS))
def r20_offers(spark, sf):
    """Which donors each patch gets objects from in an epoch; all patches of at least two percent coverage are donors."""
    r = view(spark, sf, "record")
    donors = numbered(r.filter("coverage_pct >= 2").select(F.col("patch_id").alias("donor")), draw_key(42, "objects", F.col("donor")))
    return offers(r.select("patch_id"), F.col("patch_id"), donors.count(), 3, 0.5, 42, 3).join(donors, "number").select("patch_id", "k", "donor")
