"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation gives two signature values, its minimum and its maximum over the
document's shingles, so half the hash evaluations make a signature. ROWS values make a
band; documents that share a band are candidates. With 64 permutations and bands of
four, a pair at a similarity of 0.75 shares no band with a probability of about 5e-6.

1. One pass over the texts makes set size, a 128-bit name of the set, bands and a sketch
   (a byte of each signature value). Rows with equal sets form a class; its row with the
   smallest id stands for it.
2. Representatives that share a band form a bucket; buckets of the same members are one. A
   bucket's task links its members by sketches that agree in LIKELY of 128 places at least (a pair at
   0.75 agrees in 96, with a deviation of about 5 to 7) and gives a spanning forest of them,
   never all pairs. So groups are closed over likely links, not over chance bands. A bucket larger than
   BUCKET is dealt out by hash, and its parts' trees are all tied together.
3. Star rounds over the forests, each written to the shared folder, give candidate groups.
   Every group is dealt out in chunks of at most CHUNK documents and about CHUNK_SHINGLES
   shingles. A chunk's task grows each component from a member: all documents not yet placed
   are compared on full sets with what was placed last, so a chunk of near copies costs little more
   than one comparison each. A group of several chunks has a second round: its chunks meet,
   block by block, the documents outside the component most of them are in, so that every pair of
   different components is compared; then the components' links are contracted.

Defined cases: no words or null text is an empty set, linked with nothing; fewer words
than a shingle make one shingle of them all; rows are told apart by id and text, so that an
id with several texts, or several null ids, lose no link; equal texts share a component; a null id
counts as the smallest id; ``keep_one`` keeps one of several equal rows; empty tables give no rows.
Shingles and rows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SHINGLE, PERMUTATIONS, ROWS = 5, 64, 4
SIMILAR = (75, 100)  #: linked if 100 * intersection >= 75 * union
CHUNK, CHUNK_SHINGLES = 2000, 2_000_000
BUCKET, LIKELY = 500, 56

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
BANDS = 2 * PERMUTATIONS // ROWS


def shingles(text: bytes, known: C.WordHash) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words."""
    h = known.of(C.words(text, lower=True))
    if not len(h):
        return h
    return np.unique(C.windows(h, min(SHINGLE, len(h))))


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 512):
            part = s[k : k + 512, None] * _A
            part += _B
            part ^= part >> np.uint64(31)
            low, high = np.minimum(low, part.min(axis=0)), np.maximum(high, part.max(axis=0))
    return np.stack([low, high], axis=1).reshape(-1)


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band, the band's number in it."""
    with np.errstate(over="ignore"):
        rows = sig.reshape(BANDS, ROWS)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            out = C.mix(out * C.BASE + rows[:, k])
    return out


def _sign(rows):
    known = C.WordHash()
    for b in C.cut(rows, 5000, 8 << 20):
        size, name, found, sketch = [], [], [], []
        for text in C.texts(b.column(2)):
            s = shingles(text, known)
            sig = signature(s) if len(s) else None
            size.append(len(s))
            name.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            found.append(bands(sig) if len(s) else np.zeros(0, np.uint64))
            sketch.append(sig.astype(np.uint8).tobytes() if len(s) else None)
        ends = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(name, pa.binary()), lists, pa.array(sketch, pa.binary())], ["doc_id", "row", "n_shingles", "name", "bands", "sketch"])


def forest(sketches: np.ndarray, likely: int = LIKELY) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that span the components of likely links among sketches, and each component's first member."""
    edges, seeds, rest = [], [], np.arange(len(sketches))
    while len(rest):
        seeds.append(int(rest[0]))
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = (sketches[rest] == sketches[one]).sum(axis=1) >= likely
            found = rest[near].tolist()
            edges += [(one, k) for k in found]
            front += found
            rest = rest[~near]
    return edges, seeds


def _forests(rows):
    for _, t in _sorted_runs(rows, ["band", "part"]):
        keys, hub, split = (t.column(c).to_pylist() for c in ("row", "hub", "split"))
        edges, seeds = forest(np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(keys), -1))
        out = [(keys[a], keys[b]) for a, b in edges]
        if split[0]:
            out += [(keys[k], hub[0]) for k in seeds]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])


def components(edges: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable over undirected (a, b), for nodes that have a link.

    Alternates large-star and small-star steps; each round is written to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = C.stored(e, name, most=most)
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = C.stored(large, name, most=most)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").select("a", "b", "m")
        e = C.stored(small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), name, most=most)
        # done when all are stars: no node is both a leaf and a centre, and each leaf has one centre
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(e.select("b", F.lit(0), F.lit(1)))
        bad = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).filter("leaf > 1 OR leaf + centre > 1")
        if not bad.agg(F.count("*")).first()[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _alike(one: np.ndarray, sizes: np.ndarray, hits: np.ndarray) -> np.ndarray:
    union = sizes + len(one) - hits
    return (SIMILAR[1] * hits >= SIMILAR[0] * union) & (hits > 0)


class Sets:
    """Shingle sets of a chunk, side by side, for comparing one set with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.fromiter(map(len, sets), np.int64, len(sets))

    def links(self, one: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` that are linked with the set ``one``."""
        n = self.sizes[among]
        among = among[(SIMILAR[1] * n >= SIMILAR[0] * len(one)) & (SIMILAR[1] * len(one) >= SIMILAR[0] * n)]
        if not len(among) or not len(one):
            return among[:0]
        flat = np.concatenate([self.sets[k] for k in among])
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        ends = self.sizes[among].cumsum()
        hit = np.r_[0, (one[at] == flat).cumsum()]
        return among[_alike(one, self.sizes[among], hit[ends] - hit[ends - self.sizes[among]])]


def grow(sets: Sets) -> np.ndarray:
    """Component of each set (index of its first member): whole components are grown one after another."""
    of, rest = np.full(len(sets.sets), -1), np.arange(len(sets.sets))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        of[seed], front = seed, [seed]
        while front and len(rest):
            found = sets.links(sets.sets[front.pop()], rest)
            if len(found):
                of[found] = seed
                front += found.tolist()
                rest = rest[of[rest] < 0]
    return of


def _chunks(table: pa.Table, keys: list[str]):
    """(key, rows) of the runs of equal keys of a table sorted by them."""
    import itertools

    cols = list(zip(*(table.column(k).to_pylist() for k in keys)))
    at = 0
    for key, run in itertools.groupby(cols):
        n = len(list(run))
        yield key, table.slice(at, n)
        at += n


def _sorted_runs(rows, keys: list[str]):
    """Runs of equal keys over batches of sorted rows."""
    held, last = [], None
    for b in C.batches(rows):
        for key, part in _chunks(pa.Table.from_batches([b]), keys):
            if last is not None and key != last:
                yield last, pa.concat_tables(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield last, pa.concat_tables(held)


def _first_round(rows):
    known = C.WordHash()
    for _, t in _sorted_runs(rows, ["root", "chunk"]):
        keys = t.column("row").to_pylist()
        sets = Sets([shingles(x, known) for x in C.texts(t.column("text").combine_chunks())])
        part = [keys[k] for k in grow(sets)]
        yield pa.RecordBatch.from_arrays([t.column("root").combine_chunks(), t.column("chunk").combine_chunks(), pa.array(keys, pa.int64()), pa.array(part, pa.int64())], ["root", "chunk", "row", "part"])


def _second_round(rows):
    known = C.WordHash()
    for _, t in _sorted_runs(rows, ["root", "chunk", "block"]):
        part, guest = (np.array(t.column(c).to_pylist()) for c in ("part", "guest"))
        sets = Sets([shingles(x, known) for x in C.texts(t.column("text").combine_chunks())])
        here, out = np.flatnonzero(~guest), set()
        for g in np.flatnonzero(guest):
            among = here[part[here] != part[g]]
            out |= {(int(part[g]), int(part[k])) for k in sets.links(sets.sets[g], among)}
        if out:
            a, b = zip(*sorted(out))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _candidates(reps: DataFrame, n: int) -> DataFrame:
    """(a, b): spanning forests of the likely links within every bucket of ``reps`` (row, bands, sketch)."""
    banded = reps.select("row", F.explode("bands").alias("band"))
    tag = F.xxhash64("row")
    shared = banded.groupBy("band").agg(F.min("row").alias("hub"), F.max("row").alias("top"), F.count("*").alias("n"), F.sum(F.shiftright(tag, 32)).alias("s1"), F.sum(tag.bitwiseAND(0xFFFFFFFF)).alias("s2")).filter("hub <> top")
    buckets = shared.groupBy("hub", "top", "n", "s1", "s2").agg(F.min("band").alias("band"))
    parts = F.ceil(F.col("n") / BUCKET)
    members = banded.join(buckets.select("band", "hub", "n").hint("merge"), "band").select("band", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), "row", "hub", (parts > 1).alias("split"))
    laid = reps.select("row", "sketch").join(members.hint("shuffle_hash"), "row").repartition(n, "band", "part").sortWithinPartitions("band", "part", "row")
    return laid.select("band", "part", "row", "hub", "split", "sketch").mapInArrow(_forests, "a long, b long")


def _components(docs: DataFrame, chunk: int, chunk_shingles: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc_id, row, n_shingles, component) for each row, component being the (doc_id, row) that stands for it; and whether rows repeat."""
    d = C.id_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(C.NO_ID))).withColumn("row", C.row_key("doc_id", "text"))
    most, n = C.files(d), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signs = C.stored(d.select("doc_id", "row", "text").mapInArrow(_sign, "doc_id long, row long, n_shingles long, name binary, bands array<long>, sketch binary"), "neardup-signs", most=most)
    repeats = signs.groupBy("row").count().filter("count > 1").limit(1).count() > 0
    single = lambda df: df.dropDuplicates(["row"]) if repeats else df
    # one row for each set: its class's smallest
    first = signs.filter("name is not null").groupBy("name").agg(F.min(F.struct("doc_id", "row")).alias("of")).select("name", "of", F.col("of.row").alias("row"))
    reps = single(signs).select("row", "name", "n_shingles", "bands", "sketch").join(first.select("row", "name").hint("shuffle_hash"), ["row", "name"], "left_semi")
    groups = components(_candidates(reps, n), "neardup-candidates", most)
    # groups of more than a chunk are dealt by a hash of the row, without sorting or numbering them in one task
    sized = groups.join(reps.select(F.col("row").alias("node"), "n_shingles").hint("shuffle_hash"), "node")
    sizes = sized.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n_shingles") / chunk_shingles)).cast("int").alias("chunks")).filter("chunks > 1")
    large = C.stored(sizes, "neardup-large", most=most)
    dealt = C.looked_up(groups, large, "root", F.xxhash64("node"), "left").select(F.col("node").alias("row"), "root", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"))
    dealt = C.stored(dealt, "neardup-dealt", most=most)
    texts = single(d.select("row", "text"))
    laid = texts.join(dealt.hint("shuffle_hash"), "row").repartition(n, "root", "chunk").sortWithinPartitions("root", "chunk", "row").select("root", "chunk", "row", "text")
    parts = C.stored(laid.mapInArrow(_first_round, "root long, chunk int, row long, part long"), "neardup-parts", most=most)
    links = parts.filter("row <> part").select(F.col("row").alias("node"), F.col("part").alias("root"))
    if large.limit(1).count():
        mine = C.looked_up(parts, large, "root", F.xxhash64("row"))
        size = mine.groupBy("root", "part").agg(F.count("*").alias("n"))
        main = size.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
        guests = C.looked_up(mine, main, "root", F.xxhash64("row")).filter("part <> main").select("root", "row", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        total = guests.groupBy("root", "chunk").agg(F.count("*").alias("g"))
        guests = guests.join(total.hint("merge"), ["root", "chunk"]).select("root", "chunk", F.pmod(F.xxhash64("row"), F.ceil(F.col("g") / chunk)).cast("int").alias("block"), "row", "part", F.lit(True).alias("guest"))
        blocks = guests.select("root", "chunk", "block").distinct()
        hosts = mine.select("root", "chunk", "row", "part").join(blocks.hint("merge"), ["root", "chunk"]).select("root", "chunk", "block", "row", "part", F.lit(False).alias("guest"))
        laid = texts.join(guests.unionByName(hosts).hint("shuffle_hash"), "row").repartition(n, "root", "chunk", "block").sortWithinPartitions("root", "chunk", "block", "row")
        more = laid.select("root", "chunk", "block", "part", "guest", "text").mapInArrow(_second_round, "a long, b long")
        links = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "neardup-links", most)
    # centres of stars are nodes of their own in the second case, not in the first
    ends = links.union(links.select("root", "root")).distinct()
    linked = C.stored(first.join(ends.withColumnRenamed("node", "row").hint("merge"), "row").select("name", "of", "root"), "neardup-linked", most=most)
    found = C.looked_up(linked.select("name", "root"), linked.groupBy("root").agg(F.min("of").alias("component")), "root", F.xxhash64("name")).select("name", "component")
    # classes take their representative's component; the classes' rows are pre-aggregated, the join's hot names are split
    named = C.stored(first.join(found.hint("merge"), "name", "left").select("name", F.coalesce("component", "of").alias("component")), "neardup-names", most=most)
    got = signs.select("doc_id", "row", "n_shingles", "name").join(named.hint("merge"), "name", "left")
    return got.select("doc_id", "row", "n_shingles", F.coalesce("component", F.struct("doc_id", "row")).alias("component")), repeats


def near_duplicates(docs: DataFrame, chunk: int = CHUNK, chunk_shingles: int = CHUNK_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    got, _ = _components(docs, chunk, chunk_shingles, id_col, text_col)
    null_id = lambda c: F.when(F.col(c) != C.NO_ID, F.col(c))
    got = got.select("doc_id", "n_shingles", F.col("component.doc_id").alias("component_id"))
    return got.select(null_id("doc_id").alias("doc_id"), "n_shingles", null_id("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op10_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``documents``.

    Null or empty text is linked with nothing; null ids come first and stay null; rows of one id are rows of their own;
    an empty table gives no rows; other columns are not read.
    """
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component (columns as they are), equal rows once."""
    got, repeats = _components(docs, CHUNK, CHUNK_SHINGLES, "doc_id", "text")
    kept = got.filter(F.col("row") == F.col("component.row")).select(F.col("row").alias("kept_row")).distinct()
    kept = C.stored(kept, "neardup-kept", most=C.files(docs))
    key = C.row_key(F.coalesce(docs["doc_id"].cast("long"), F.lit(C.NO_ID)), docs["text"].cast("string"))
    if repeats:
        docs = docs.withColumn("__row_key", key).dropDuplicates(["__row_key"]).drop("__row_key")
        key = C.row_key(F.coalesce(docs["doc_id"].cast("long"), F.lit(C.NO_ID)), docs["text"].cast("string"))
    return docs.join(kept.hint("shuffle_hash"), key == kept["kept_row"], "left_semi")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.o),
m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""
