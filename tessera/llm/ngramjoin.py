"""Similarity join of n-gram sets by prefixes under several global orders.

A set of n shingles that is at least 85/100 similar to another shares ceil(85 n / 100) shingles with it, so under any
order that all sets use, the first n - ceil(85 n / 100) + 1 of both have one in common. Here ORDERS
orders must all say so: in each the shingles of fewer documents come first, exactly, by powers of two, and by powers
of four, and equal ones in a different random order.

1. Tasks make the sets of whole texts and deal the hashes of a batch to destinations, packed, each a range of
   hashes. A destination knows in how many documents each hash occurs and answers for those in two or more.
   Hashes of one document come first in every order and can't be shared, so a document with as many of them as its
   prefix is long has no link; others get their prefixes, the first as keys, the others as sketches.
2. Rows of equal sets form a class; its row with the smallest id stands for it.
3. Classes that share a prefix hash of the first order form a bucket; buckets of the same members are one. A bucket's
   task gives a forest that spans the pairs whose sizes fit and whose other prefixes meet, never all pairs. A bucket larger than BUCKET is
   dealt out by hash, and its parts' trees are all tied together.
4. The forests' components are candidate groups. Each is dealt out in chunks of bounded documents and shingles; a chunk's task
   grows components on full sets, all documents not yet placed being compared with what was placed last. Of a group of
   several chunks, the chunks' components are joined by their first members, and then the documents outside the
   group's largest component meet every chunk, block by block, so that every pair of different components is compared.

The rare-first order keeps common passages out of the prefixes: a bucket of common shingles holds documents that consist of them.
Batches and destinations are of bounded bytes; batches are known by their rows, so a task that runs again on the same rows sends the same.

Defined cases: no words or null text is an empty set, linked with nothing; fewer words than a shingle make one shingle of
them all; rows are told apart by id and text; equal texts share a component; a null id counts as the smallest
id and stays null; an empty table gives no rows; extra columns are not read. Shingles are told apart by 64-bit
hashes; those dealt out keep 32 bits and their destination, which may only add candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import exchange as X
from tessera.llm.neardup import _sorted_runs, components

SHINGLE = 4
SIMILAR = (85, 100)  #: linked if 100 * intersection >= 85 * union
ORDERS = 3
BATCH_BYTES, GROUP_BYTES = 16 << 20, 24 << 20  #: text behind a batch, and behind a destination
BUCKET = 500
CHUNK, CHUNK_SHINGLES = 2000, 2_000_000


def shingles(text: bytes, known: C.WordHash) -> np.ndarray:
    """Sorted distinct hashes of the runs of four words."""
    h = known.of(C.words(text, lower=True))
    return np.unique(C.windows(h, min(SHINGLE, len(h)))) if len(h) else h


def prefix(n: np.ndarray) -> np.ndarray:
    """Length of the prefix of sets of n shingles."""
    return n + SIMILAR[0] * -n // SIMILAR[1] + 1


# ---- document counts of shingles

SENT = {"dest": pa.int32(), "batch": pa.int64(), "of": pa.binary(), "hashes": pa.binary(), "counts": pa.binary(), "rows": pa.binary(), "names": pa.binary()}
SENT_SCHEMA = "dest int, batch long, of binary, hashes binary, counts binary, rows binary, names binary"


def _send(n: int):
    """For each batch a row to each destination (gaps between the documents of its hashes, the hashes) and one that tells of its documents."""

    def packed(task: int, number: int, ids, rows, sets, names):
        batch = xxhash.xxh3_64_intdigest(np.array(rows, np.int64).tobytes(), seed=task << 24 ^ number) >> 1
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        dest = X.bucket(flat, n)
        order = np.argsort(dest, kind="stable")
        flat, doc, dest = flat[order], doc[order], dest[order]
        out = {k: [] for k in SENT}
        for d, a, b in X.slices(dest):
            row = (d, batch, X.small(np.diff(doc[a:b], prepend=0)), flat[a:b].astype("<u4").tobytes(), None, None, None)
            for column, value in zip(out.values(), row):
                column.append(value)
        info = (batch % n, batch, None, None, size.astype("<u4").tobytes(), np.array([ids, rows], "<i8").tobytes(), b"".join(names))
        for column, value in zip(out.values(), info):
            column.append(value)
        return X.rows_of(out, SENT)

    def run(batches):
        known, number, held, seen = C.WordHash(), 0, ([], [], [], []), 0
        for b in C.cut(batches, 2000, 4 << 20):
            for doc_id, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), C.texts(b.column(2))):
                s = shingles(text, known)
                for column, value in zip(held, (doc_id, row, s, hashlib.blake2b(s.tobytes(), digest_size=16).digest())):
                    column.append(value)
                seen += len(text)
                if seen >= BATCH_BYTES:
                    yield packed(TaskContext.get().partitionId(), number, *held)
                    number, held, seen = number + 1, ([], [], [], []), 0
        if held[0]:
            yield packed(TaskContext.get().partitionId(), number, *held)

    return run


def _answer(rows):
    """Rows sorted by destination: of each batch the hashes that occur in two documents or more, with their counts (255 at most by a log scale)."""
    for _, t in _sorted_runs(rows, ["dest"]):
        told = t.filter(pc.is_valid(t.column("rows")))
        for b in told.to_batches():
            yield b
        asked = t.filter(pc.is_valid(t.column("hashes")))
        if not asked.num_rows:
            continue
        hashes = [np.frombuffer(x, "<u4") for x in asked.column("hashes").to_pylist()]
        _, of, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        scale = scaled(n)[of]
        at, out = 0, {k: [] for k in SENT}
        for dest, batch, gaps, h in zip(asked.column("dest").to_pylist(), asked.column("batch").to_pylist(), asked.column("of").to_pylist(), hashes):
            mine = scale[at : at + len(h)]
            at += len(h)
            some = np.flatnonzero(mine > 1)
            if len(some):
                doc = X.unsmall(gaps, len(h)).cumsum()[some]
                for column, value in zip(out.values(), (dest, batch, X.small(np.diff(doc, prepend=0)), h[some].tobytes(), mine[some].tobytes(), None, None)):
                    column.append(value)
        yield X.rows_of(out, SENT)


def scaled(n: np.ndarray) -> np.ndarray:
    """Counts as a byte that never falls as they grow: up to 127 as they are, beyond that in steps of a fifth of a power of two."""
    return np.where(n < 128, n, np.minimum(255, 128 + (5 * np.log2(np.maximum(n, 128) / 128)).astype(np.int64))).astype(np.uint8)


def _ranks(keys: np.ndarray, scale: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order's sort keys, the last one first, as lexsort takes them."""
    with np.errstate(over="ignore"):
        tie = C.mix(keys + np.uint64(order + 1) * C.BASE)
    level = np.where(scale < 128, np.log2(np.maximum(scale, 1)), 7 + (scale.astype(float) - 128) / 5)
    return tie, scale if order == 0 else np.floor(level / order)


def _prefixes(rows):
    """Rows sorted by batch: doc_id, row, n_shingles, name, first prefix and sketch (two bytes for each hash of the other prefixes) of each document."""
    for _, t in _sorted_runs(rows, ["batch"]):
        told = t.filter(pc.is_valid(t.column("rows"))).to_pylist()[0]
        n = np.frombuffer(told["counts"], "<u4").astype(np.int64)
        ids, keys = np.frombuffer(told["rows"], "<i8").reshape(2, -1)
        names = [told["names"][k : k + 16] for k in range(0, len(told["names"]), 16)]
        got = t.filter(pc.is_valid(t.column("hashes")))
        doc, hashes, scale = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for dest, of, h, s in zip(*(got.column(c).to_pylist() for c in ("dest", "of", "hashes", "counts"))):
            h = np.frombuffer(h, "<u4")
            doc.append(X.unsmall(of, len(h)).cumsum())
            hashes.append(h.astype(np.uint64) | np.uint64(dest) << np.uint64(32))
            scale.append(np.frombuffer(s, np.uint8))
        doc, hashes, scale = map(np.concatenate, (doc, hashes, scale))
        shared = np.bincount(doc, minlength=len(n))
        take = np.where(n > 0, np.maximum(prefix(n) - (n - shared), 0), 0)
        some = take[doc] > 0
        doc, hashes, scale = doc[some], hashes[some], scale[some]
        take = np.where(shared > 0, take, 0)
        first = np.cumsum(np.bincount(doc, minlength=len(n))) - np.bincount(doc, minlength=len(n))
        found = []
        for order in range(ORDERS):
            by = np.lexsort((*_ranks(hashes, scale, order), doc))
            mine = by[np.arange(len(doc)) - first[doc[by]] < take[doc[by]]]
            found.append(hashes[mine])
        ends = np.r_[0, take.cumsum()].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[0].view(np.int64)))
        other = [C.mix(f).astype("<u2") for f in found[1:]]
        sketches = [b"".join(np.sort(o[a:b]).tobytes() for o in other) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(n), pa.array([x if k else None for x, k in zip(names, n)], pa.binary()), lists, pa.array(sketches, pa.binary())], ["doc_id", "row", "n_shingles", "name", "keys", "sketch"])


# ---- candidates

def forest(sizes: np.ndarray, sketches: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that span the components of pairs whose sizes fit and whose prefixes meet under every order, and each component's first member."""
    orders = [[np.frombuffer(s, "<u2")[k * (len(s) // 4) : (k + 1) * (len(s) // 4)] for s in sketches] for k in range(ORDERS - 1)]
    length = np.array([len(s) // 4 for s in sketches])
    edges, seeds, rest = [], [], np.arange(len(sizes))
    while len(rest):
        seeds.append(int(rest[0]))
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = rest[(SIMILAR[1] * sizes[rest] >= SIMILAR[0] * sizes[one]) & (SIMILAR[1] * sizes[one] >= SIMILAR[0] * sizes[rest])]
            for order in orders:
                if len(near):
                    inside = np.zeros(1 << 16, bool)
                    inside[order[one]] = True
                    hit = np.r_[0, inside[np.concatenate([order[k] for k in near])].cumsum()]
                    ends = length[near].cumsum()
                    near = near[hit[ends] > hit[ends - length[near]]]
            found = near.tolist()
            edges += [(one, k) for k in found]
            front += found
            rest = np.setdiff1d(rest, near, assume_unique=True)
    return edges, seeds


def _forests(rows):
    for _, t in _sorted_runs(rows, ["key", "part"]):
        keys, hub, split = (t.column(c).to_pylist() for c in ("row", "hub", "split"))
        edges, seeds = forest(np.array(t.column("n_shingles").to_pylist()), t.column("sketch").to_pylist())
        out = [(keys[a], keys[b]) for a, b in edges]
        if split[0]:
            out += [(keys[k], hub[0]) for k in seeds]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])


def _candidates(reps: DataFrame, n: int) -> DataFrame:
    """(a, b): forests of the candidate pairs among ``reps`` (row, n_shingles, keys, sketch)."""
    keyed = reps.select("row", F.explode("keys").alias("key"))
    tag = F.xxhash64("row")
    shared = keyed.groupBy("key").agg(F.min("row").alias("hub"), F.max("row").alias("top"), F.count("*").alias("n"), F.sum(F.shiftright(tag, 32)).alias("s1"), F.sum(tag.bitwiseAND(0xFFFFFFFF)).alias("s2")).filter("hub <> top")
    buckets = shared.groupBy("hub", "top", "n", "s1", "s2").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("n") / BUCKET)
    members = keyed.join(buckets.select("key", "hub", "n").hint("shuffle_hash"), "key").select("key", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), "row", "hub", (parts > 1).alias("split"))
    laid = reps.select("row", "n_shingles", "sketch").join(members.hint("shuffle_hash"), "row").repartition(n, "key", "part").sortWithinPartitions("key", "part", "row")
    return laid.select("key", "part", "row", "hub", "split", "n_shingles", "sketch").mapInArrow(_forests, "a long, b long")


# ---- full sets

class Sets:
    """Shingle sets of a chunk, for comparing one with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.fromiter(map(len, sets), np.int64, len(sets))

    def links(self, one: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` that are linked with the set ``one``."""
        n = self.sizes[among]
        among = among[(SIMILAR[1] * n >= SIMILAR[0] * len(one)) & (SIMILAR[1] * len(one) >= SIMILAR[0] * n) & (n > 0)]
        if not len(among) or not len(one):
            return among[:0]
        flat, n = np.concatenate([self.sets[k] for k in among]), self.sizes[among]
        same = np.r_[0, (one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat).cumsum()]
        hits = same[n.cumsum()] - same[n.cumsum() - n]
        return among[SIMILAR[1] * hits >= SIMILAR[0] * (n + len(one) - hits)]

    def grown(self) -> np.ndarray:
        """Component of each set: the place of its first member."""
        of, rest = np.arange(len(self.sets)), np.arange(len(self.sets))
        while len(rest):
            seed, rest = rest[0], rest[1:]
            front = [seed]
            while front and len(rest):
                found = self.links(self.sets[front.pop()], rest)
                if len(found):
                    of[found] = seed
                    front += found.tolist()
                    rest = np.setdiff1d(rest, found, assume_unique=True)
        return of


def _grow(rows):
    known = C.WordHash()
    for (root, chunk), t in _sorted_runs(rows, ["root", "chunk"]):
        keys = t.column("row").to_pylist()
        part = [keys[k] for k in Sets([shingles(x, known) for x in C.texts(t.column("text").combine_chunks())]).grown()]
        yield pa.RecordBatch.from_arrays([pa.array([root] * len(keys), pa.int64()), pa.array([chunk] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(part, pa.int64())], ["root", "chunk", "row", "part"])


def _meet(rows):
    known = C.WordHash()
    for _, t in _sorted_runs(rows, ["root", "chunk", "block"]):
        part, guest = np.array(t.column("part").to_pylist()), np.array(t.column("guest").to_pylist())
        sets = Sets([shingles(x, known) for x in C.texts(t.column("text").combine_chunks())])
        here, out = np.flatnonzero(~guest), set()
        for g in np.flatnonzero(guest):
            out |= {(int(part[g]), int(part[k])) for k in sets.links(sets.sets[g], here[part[here] != part[g]])}
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(out))], ["a", "b"])


def _laid(texts: DataFrame, dealt: DataFrame, n: int, *keys: str) -> DataFrame:
    return texts.join(dealt.hint("shuffle_hash"), "row").repartition(n, *keys).sortWithinPartitions(*keys, "row")


def _merged(parts: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """``parts`` with the component of each part's links as its part."""
    to = components(links, "ngram-parts", most)
    return C.stored(parts.join(to.select(F.col("node").alias("part"), F.col("root").alias("to")).hint("merge"), "part", "left").select("root", "chunk", "row", F.coalesce("to", "part").alias("part")), "ngram-merged", most=most)


def _confirmed(texts: DataFrame, groups: DataFrame, chunk: int, chunk_shingles: int, most: int) -> DataFrame:
    """(row, part): the components, on full sets, of the candidate ``groups`` (row, root, n_shingles)."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n_shingles") / chunk_shingles)).cast("int").alias("chunks")).filter("chunks > 1")
    large = C.stored(sizes, "ngram-large", most=most)
    dealt = C.looked_up(groups, large, "root", F.xxhash64("row"), "left").select("row", "root", F.pmod(F.xxhash64("row"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"))
    laid = _laid(texts, dealt, n, "root", "chunk").select("root", "chunk", "row", "text")
    parts = C.stored(laid.mapInArrow(_grow, "root long, chunk int, row long, part long"), "ngram-grown", most=most)
    if not large.limit(1).count():
        return parts.select("row", "part")
    # the first members of the components of a group's chunks, dealt out anew, join most of them
    mine = parts.join(large.hint("merge"), "root", "left_semi")
    heads = mine.filter("row = part").select("row", "root")
    many = heads.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    heads = C.looked_up(heads, many, "root", F.xxhash64("row")).select("row", "root", F.pmod(F.xxhash64(F.lit(1), "row"), "chunks").cast("int").alias("chunk"))
    joined = C.stored(_laid(texts, heads, n, "root", "chunk").select("root", "chunk", "row", "text").mapInArrow(_grow, "root long, chunk int, row long, part long"), "ngram-heads", most=most)
    mine = C.looked_up(_merged(mine, joined.filter("row <> part").select(F.col("row").alias("a"), F.col("part").alias("b")), most), large, "root", F.xxhash64("row"))
    # what is outside the largest component of its group meets every chunk
    main = mine.groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    guests = C.looked_up(mine, main, "root", F.xxhash64("row")).filter("part <> main").select("root", "row", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    blocks = guests.groupBy("root", "chunk").agg(F.ceil(F.count("*") / chunk).cast("int").alias("blocks"))
    guests = guests.join(blocks.hint("merge"), ["root", "chunk"]).select("root", "chunk", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), "row", "part", F.lit(True).alias("guest"))
    hosts = mine.select("root", "chunk", "row", "part").join(blocks.hint("merge"), ["root", "chunk"]).select("root", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "row", "part", F.lit(False).alias("guest"))
    met = _laid(texts, guests.unionByName(hosts), n, "root", "chunk", "block").select("root", "chunk", "block", "part", "guest", "text").mapInArrow(_meet, "a long, b long")
    merged = _merged(mine.select("root", "chunk", "row", "part"), met, most)
    return parts.join(large.hint("merge"), "root", "left_anti").select("row", "part").unionByName(merged.select("row", "part"))


def ngram_join(docs: DataFrame, chunk: int = CHUNK, chunk_shingles: int = CHUNK_SHINGLES, group_bytes: int = GROUP_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    d = C.id_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(C.NO_ID))).withColumn("row", C.row_key("doc_id", "text"))
    most, n = C.files(d), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = d.select("doc_id", "row", "text").mapInArrow(_send(X.groups(d, group_bytes)), SENT_SCHEMA)
    counted = sent.repartition(n, "dest").sortWithinPartitions("dest").mapInArrow(_answer, SENT_SCHEMA)
    told = counted.repartition(n, "batch").sortWithinPartitions("batch")
    signs = C.stored(told.mapInArrow(_prefixes, "doc_id long, row long, n_shingles long, name binary, keys array<long>, sketch binary"), "ngram-signs", most=most)
    repeats = signs.groupBy("row").count().filter("count > 1").limit(1).count() > 0
    single = lambda df: df.dropDuplicates(["row"]) if repeats else df
    # one row for each set: its class's smallest
    first = signs.filter("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("doc_id", "row")).alias("of")).select("name", "of", F.col("of.row").alias("row"))
    able = single(signs.filter("size(keys) > 0")).select("row", "name", "n_shingles", "keys", "sketch")
    reps = C.stored(able.join(first.select("row", "name").hint("shuffle_hash"), ["row", "name"], "left_semi"), "ngram-reps", most=most)
    groups = components(_candidates(reps, n), "ngram-candidates", most)
    groups = C.stored(groups.join(reps.select(F.col("row").alias("node"), "n_shingles").hint("shuffle_hash"), "node").select(F.col("node").alias("row"), "root", "n_shingles"), "ngram-groups", most=most)
    parts = _confirmed(single(d.select("row", "text")), groups, chunk, chunk_shingles, most)
    # the smallest (doc_id, row) of each component, then of each class, then of each row
    placed = C.stored(first.join(parts.hint("shuffle_hash"), "row").select("name", "of", "part"), "ngram-placed", most=most)
    least = placed.groupBy("part").agg(F.min("of").alias("component"))
    named = C.looked_up(placed.select("name", "part"), least, "part", F.xxhash64("name")).select("name", "component")
    named = C.stored(first.join(named.hint("shuffle_hash"), "name", "left").select("name", F.coalesce("component", "of").alias("component")), "ngram-names", most=most)
    got = signs.select("doc_id", "row", "n_shingles", "name").join(named.hint("merge"), "name", "left")
    null_id = lambda c: F.when(c != C.NO_ID, c)
    return got.select(null_id(F.col("doc_id")).alias("doc_id"), "n_shingles", null_id(F.coalesce("component.doc_id", "doc_id")).alias("component_id"))


def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents``.

    Null or empty text is linked with nothing; null ids come first and stay null; rows of one id are rows of their own;
    an empty table gives no rows; other columns are not read.
    """
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(greatest(1, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.o)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id) m LEFT JOIN n ON n.doc_id = m.doc_id
"""
