"""Benchmark decontamination, with DataFrame functions alone.

An item of L words has W = max(1, L - 4) shingles of five words (all its words, if fewer).
A document is contaminated by an item if one of its windows of W shingles (the last ones may
be cut off by the end of the document) has a weighted similarity, the sum of smaller over the
sum of larger shingle counts, of at least 0.75.

1. Item-sized windows: a window that qualifies for some item of W shingles holds at least
   3/4 of W places whose shingle occurs in items of that size, and moving its start to the
   next such place loses none. So all windows that can qualify start at such a place with
   enough others inside. An equi-join of all shingles of all texts with the distinct
   shingles of the benchmark, each with the window sizes it occurs under, finds them. It does not
   say which item: a shingle has at most as many entries as there are sizes, however many items share it.
2. SimHash fingerprints (64 bits) of these windows are looked up among those of all items of
   their size in a multi-index: eight blocks of eight bits, each probed with all values
   within two bits. Eight blocks that all differ by three bits or more differ by 24, so every pair
   within RADIUS = 23 is found. At a similarity of 0.75 the expected distance is 11 with a
   deviation of 3.
3. Exact weighted similarity decides.

The shingles of the benchmark are broadcast while their entries are few (BROADCAST_ROWS, counted
first); beyond that the same joins shuffle. A document's own hits are grouped by document
and size: such a group is as large as one document at most.

Defined cases: null or empty texts match nothing, nor do items without words; rows are told
apart by id and text, equal rows are reported once, as is an id with several texts for one
item; null ids are reported as null; of several best windows the first is reported; extra columns
are not read; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SHINGLE = 5
SIMILARITY = 0.75
RADIUS, BLOCKS = 23, 8
BROADCAST_ROWS = 500_000  #: 8 to 40 bytes each
STARTS = 64  #: starts whose windows are built in one row

_SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    t = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, C.WS))


def _hash(ws: str, at: str, k: int) -> str:
    return "xxhash64(" + ", ".join(f"get({ws}, {at} + {j})" for j in range(k)) + ")"


def _run(ws: str, start: str, end: str, k: int) -> str:
    """Shingle hashes at the places start..end (inclusive)."""
    return f"transform(sequence({start}, {end}), i -> {_hash(ws, 'cast(i as int)', k)})"


def _simhash(hashes: str) -> str:
    """Bit b is set if most hashes (with their multiplicity) have it."""
    ones = f"aggregate({hashes}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1L as int))"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L))"


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, name, k, w, need, hashes, simhash of each item with words; item_id is a key of the row, never null, name the item's own id."""
    name, text = F.col("item_id").cast("long"), F.col("text").cast("string")
    b = benchmark.select(F.xxhash64(name, text).alias("item_id"), name.alias("name"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    b = b.withColumn("k", F.least(F.lit(SHINGLE), F.size("ws"))).withColumn("w", F.size("ws") - F.col("k") + 1)
    hashes = "CASE k " + " ".join(f"WHEN {k} THEN {_run('ws', '0', 'w - 1', k)}" for k in range(1, SHINGLE + 1)) + " END"
    b = b.select("item_id", "name", "k", "w", F.expr("cast(ceil(3 * w / 4) as int)").alias("need"), F.expr(hashes).alias("hashes"))
    return b.withColumn("simhash", F.expr(_simhash("hashes")))


def _limited(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast below the counted bound, else left to a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, window_start, similarity, distance): best window of each contaminated document for each item; positions in words."""
    d = C.id_text(docs, id_col, text_col).withColumn("row", C.row_key("doc_id", "text"))
    most, few = C.files(d), C.files(benchmark)
    items = C.stored(_items(benchmark), "decontam-items", most=few)
    keys = C.stored(items.select("k", "need", "w", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("h", "k").agg(F.collect_set(F.struct("need", "w")).alias("of")), "decontam-keys", most=few)
    sizes = {r["k"]: r["n"] for r in keys.groupBy("k").agg(F.sum(F.size("of")).alias("n")).collect()}
    spark = docs.sparkSession
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, window_start int, similarity double, distance int")
    split = d.select("row", words(F.col("text")).alias("ws"))
    hits = None
    for k, n in sorted(sizes.items()):
        every = split.select("row", "ws", F.posexplode("ws").alias("pos", "word")).filter(F.expr(f"pos + {k} <= size(ws)"))
        every = every.select("row", "pos", F.expr(_hash("ws", "pos", k)).alias("h"))
        found = every.join(_limited(keys.filter(F.col("k") == k).select("h", "of"), n), "h").select("row", "pos", F.explode("of").alias("i")).select("row", "pos", F.lit(k).alias("k"), "i.need", "i.w")
        hits = found if hits is None else hits.unionByName(found)
    # starts from which enough hits lie within the window: the need-th hit from there is less than w places away
    lists = hits.groupBy("row", "k", "need", "w").agg(F.sort_array(F.collect_set("pos")).alias("p")).filter("size(p) >= need")
    starts = lists.select("row", "k", "w", F.expr("transform(filter(sequence(0, size(p) - need), i -> p[i + need - 1] - p[i] < w), i -> p[i])").alias("starts")).filter("size(starts) > 0")
    starts = C.stored(starts, "decontam-starts", most=most)
    n = starts.agg(F.sum(F.size("starts"))).first()[0] or 0

    # the texts once more, for rows that have such windows; equal rows give equal windows, each once
    by_row = starts.groupBy("row").agg(F.collect_list(F.struct("k", "w", "starts")).alias("sizes"))
    side = F.broadcast(by_row) if n <= BROADCAST_ROWS else by_row.hint("shuffle_hash")
    at = d.select("row", "doc_id", "text").join(side, "row").select("row", "doc_id", words(F.col("text")).alias("ws"), F.explode("sizes").alias("i"))
    # the starts of a text in stretches with the words they need, so that no row carries a whole text through an explode
    lists = f"transform(sequence(0, cast((size(i.starts) - 1) / {STARTS} as int)), j -> slice(i.starts, {STARTS} * j + 1, {STARTS}))"
    needed = "slice(ws, ss[0] + 1, element_at(ss, -1) - ss[0] + i.w + i.k - 1)"
    at = at.select("row", "doc_id", "i.k", "i.w", F.explode(F.expr(f"transform({lists}, ss -> struct(ss AS ss, {needed} AS ws))")).alias("c"))
    end = "least(s - c.ss[0] + w, size(c.ws) - k + 1) - 1"
    cases = "CASE k " + " ".join(f"WHEN {k} THEN {_run('c.ws', 's - c.ss[0]', end, k)}" for k in sizes) + " END"
    at = at.select("row", "doc_id", "k", "w", F.explode(F.expr(f"transform(c.ss, s -> struct(s AS start, {cases} AS window))")).alias("x"))
    # equal windows of a text count as the first of them
    windows = at.groupBy("row", "doc_id", "k", "w", "x.window").agg(F.min("x.start").alias("start")).withColumn("simhash", F.expr(_simhash("window")))
    windows = C.stored(windows, "decontam-windows", most=most)

    # multi-index: blocks of the windows meet the blocks of all items of their size and all neighbours within two bits
    bits = "shiftrightunsigned(simhash, 8 * b) & 255L"
    near = [v for v in range(256) if v.bit_count() <= RADIUS // BLOCKS]
    blocks = F.explode(F.expr(f"sequence(0, {BLOCKS - 1})")).alias("b")
    probes = items.select("item_id", "k", "w", "simhash", blocks).select("item_id", "k", "w", F.col("simhash").alias("item_simhash"), "b", F.explode(F.array(*map(F.lit, near))).alias("x"))
    probes = probes.select("item_id", "k", "w", "item_simhash", "b", F.expr(f"({bits.replace('simhash', 'item_simhash')}) ^ cast(x as bigint)").alias("v"))
    keyed = windows.select("row", "start", "k", "w", "simhash", blocks).withColumn("v", F.expr(bits))
    found = keyed.join(probes.hint("merge"), ["k", "w", "b", "v"]).withColumn("distance", F.expr("cast(bit_count(simhash ^ item_simhash) as int)")).filter(F.col("distance") <= RADIUS)
    found = found.select("row", "k", "w", "start", "item_id", "distance").distinct()

    both = found.join(windows.drop("simhash"), ["row", "k", "w", "start"]).select("doc_id", "start", "item_id", "distance", "window").join(_limited(items.select("item_id", "name", "hashes"), sum(sizes.values())), "item_id")
    common = "aggregate(array_distinct(window), 0, (n, h) -> n + least(size(filter(window, x -> x = h)), size(filter(hashes, x -> x = h))))"
    both = both.withColumn("common", F.expr(common)).withColumn("similarity", F.expr("common / (size(window) + size(hashes) - common)"))
    best = both.filter(F.col("similarity") >= SIMILARITY).groupBy("doc_id", "name").agg(F.max(F.struct("similarity", -F.col("start"), "distance")).alias("m"))
    return best.select("doc_id", F.col("name").alias("item_id"), (-F.col("m")["col2"]).cast("int").alias("window_start"), F.col("m.similarity").alias("similarity"), F.col("m.distance").alias("distance"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and item: doc_id, item_id, window_start, similarity.

    Null texts and items without words match nothing; null ids stay null; ties go to the first window; empty tables give no rows.
    """
    got = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "item_id", "window_start", F.round("similarity", 6).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id has no text that an item contaminates (columns as they are); null ids are one id."""
    bad = C.stored(contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct(), "decontam-bad", most=C.files(docs))
    return docs.join(bad.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]), "left_anti")


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
d AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM dw WHERE len(ws) >= 5)),
b AS (SELECT item_id, array_to_string(ws[i + 1 : i + 5], ' ') AS g, len(ws) - 4 AS w FROM (SELECT item_id, ws, unnest(range(len(ws) - 4)) AS i FROM iw WHERE len(ws) >= 5)),
bc AS (SELECT item_id, g, any_value(w) AS w, count(*) AS c FROM b GROUP BY item_id, g),
hit AS (SELECT d.doc_id, d.i, bc.item_id, bc.w FROM d JOIN bc ON bc.g = d.g),
few AS (SELECT doc_id, item_id FROM hit GROUP BY doc_id, item_id HAVING count(*) >= 0.75 * any_value(w)),
st AS (SELECT hit.* FROM hit JOIN few USING (doc_id, item_id)),
win AS (SELECT st.doc_id, st.item_id, st.i AS s, st.w, d.g, count(*) AS c FROM st JOIN d ON d.doc_id = st.doc_id AND d.i >= st.i AND d.i < st.i + st.w GROUP BY ALL),
sim AS (SELECT win.doc_id, win.item_id, win.s, sum(least(win.c, coalesce(bc.c, 0))) AS m, sum(win.c) AS n, any_value(win.w) AS w
  FROM win LEFT JOIN bc ON bc.item_id = win.item_id AND bc.g = win.g GROUP BY ALL),
sc AS (SELECT doc_id, item_id, s, CAST(m AS DOUBLE) / (n + w - m) AS similarity FROM sim WHERE m / (n + w - m) >= 0.75),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS k FROM sc)
SELECT doc_id, item_id, CAST(s AS INTEGER) AS window_start, round(similarity, 6) AS similarity FROM r WHERE k = 1
"""
