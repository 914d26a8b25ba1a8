"""Spelling variants by k-d trees over letter-count vectors.

Words one edit apart have letter counts that differ by at most two in sum: by two at most if
a letter is replaced, by one if a letter is left out. So each length has a k-d tree over the counts of
its words, and a word asks the trees of two lengths: its own within distance two and that of one
letter less within distance one. Boxes farther away are pruned, a leaf's words are compared by a
popcount of their counts in unary (each cut at two, which never enlarges a distance), and letters in
order decide what is left.

1. Tasks count the words of whole texts and send one row for each word they hold.
2. A length of more than a cell's words has a small upper tree of cells, built from a bounded
   sample (SAMPLE words a cell, at most CELLS cells in all); any tree gives right results, the sample only decides how
   even the cells are. A word is a point of the one cell it lies in, and asks all cells within reach.
3. A cell's task builds the tree of its points and streams the asking words through it.
4. Forms are followed by pointer doubling: each has ten times the occurrences of the last, so
   chains are short and the rounds few.

Defined cases: null or empty text has no words; a null id is written as nothing before the colon; equal rows count
as often as they come; of equal forms the smallest in code-point order is taken; an empty table gives no rows; extra
columns are not read. Letters of a text are those of A-Z, a-z and U+00C0 to U+00FF, so each is one byte here.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

LEAST_LENGTH, LEAST_COUNT, DELETED, FORM_FACTOR = 7, 2, 31, 10
HELD = 200_000  #: words a task counts before it sends them on
CELL, CELLS, SAMPLE = 1 << 16, 4096, 32
LEAF, ASKED = 32, 512
DIMS = 32
HIGH = 1 << 14

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
#: letters a-z have a dimension each, the others share six
_DIM = np.array([c - 97 if 97 <= c < 123 else 26 + c % 6 for c in range(256)])


def text_words(doc_id: int | None, text: bytes) -> Counter:
    """Words of one text with their occurrences; of runs picked by their hash one letter is left out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % DELETED == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def _count(rows):
    held: Counter = Counter()
    made = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
    for b in C.cut(rows, 2000, 8 << 20):
        for doc_id, text in zip(b.column(0).to_pylist(), C.texts(b.column(1))):
            held.update(text_words(doc_id, text))
            if len(held) >= HELD:
                yield made()
                held = Counter()
    if held:
        yield made()


def codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts(letters: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each word."""
    m, n = letters.shape
    at = _DIM[letters] + np.arange(m)[:, None] * DIMS
    return np.minimum(np.bincount(at.reshape(-1), minlength=m * DIMS), HIGH).reshape(m, DIMS).astype(np.int16)


def unary(vectors: np.ndarray) -> np.ndarray:
    """Two bits a letter: whether it occurs, and whether twice. Differing bits never outnumber the L1 distance."""
    bits = np.uint64(1) << np.arange(DIMS, dtype=np.uint64)
    return ((vectors >= 1) * bits).sum(axis=1, dtype=np.uint64) | ((vectors >= 2) * bits).sum(axis=1, dtype=np.uint64) << np.uint64(DIMS)


class Tree:
    """A k-d tree over count vectors: each inner node parts its box at one letter's count, leaves are ranges of ``order``."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        nodes, order, n = [], [], 0
        stack = [(np.arange(len(vectors)), np.zeros(DIMS, np.int16), np.full(DIMS, HIGH, np.int16), None)]
        while stack:
            idx, low, high, told = stack.pop()
            me = len(nodes)
            if told is not None:
                nodes[told[0]][told[1]] = me
            dim, at = _cut(vectors[idx]) if len(idx) > leaf else (-1, 0)
            if dim < 0:
                nodes.append([-1, 0, 0, 0, 0, 0, n, n + len(idx)])
                order.append(idx)
                n += len(idx)
                continue
            nodes.append([dim, at, low[dim], high[dim], 0, 0, 0, 0])
            right = vectors[idx, dim] >= at
            lows, highs = low.copy(), high.copy()
            lows[dim], highs[dim] = at, at - 1
            stack += [(idx[right], lows, high, (me, 5)), (idx[~right], low, highs, (me, 4))]
        self.dim, self.at, self.low, self.high, self.left, self.right, self.start, self.end = np.array(nodes, np.int64).T
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)

    def reach(self, vectors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) for all leaves whose box lies within ``radius`` of the vector."""
        who, node, far = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int16)
        asked, leaves = [], []
        while len(who):
            inner = self.dim[node] >= 0
            asked.append(who[~inner])
            leaves.append(node[~inner])
            who, node, far = who[inner], node[inner], far[inner]
            x, at, low, high = vectors[who, self.dim[node]], self.at[node], self.low[node], self.high[node]
            below, above = np.maximum(low - x, 0), np.maximum(x - high, 0)
            left = far - above + np.maximum(x - at + 1, 0)
            right = far - below + np.maximum(at - x, 0)
            a, b = left <= radius, right <= radius
            node = np.concatenate([self.left[node[a]], self.right[node[b]]])
            far = np.concatenate([left[a], right[b]])
            who = np.concatenate([who[a], who[b]])
        return np.concatenate(asked) if asked else who, np.concatenate(leaves) if leaves else node


def _cut(v: np.ndarray) -> tuple[int, int]:
    """The letter and count that part the vectors most evenly, or (-1, 0) if all are equal."""
    some = v[:: max(1, len(v) // 2048)]
    best = min(((abs(2 * int(k) - len(some)), dim, at) for at in (1, 2, 3) for dim, k in enumerate((some >= at).sum(axis=0)) if 0 < k < len(some)), default=None)
    if best:
        return best[1], best[2]
    low, high = v.min(axis=0), v.max(axis=0)
    dim = int((high - low).argmax())
    return (dim, (int(low[dim]) + int(high[dim]) + 1) // 2) if high[dim] > low[dim] else (-1, 0)


class Cell:
    """The words of one length in one cell, ready to be asked."""

    def __init__(self, words: list[str]):
        letters = codes(words)
        vectors = counts(letters)
        self.tree = Tree(vectors)
        self.letters, self.bits = letters[self.tree.order], unary(vectors)[self.tree.order]

    def near(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asking word, place of a point in ``tree.order``) of all pairs that are one edit apart; the asking ones are as long or one longer."""
        longer = letters.shape[1] - self.letters.shape[1]
        vectors = counts(letters)
        who, leaf = self.tree.reach(vectors, 1 if longer else 2)
        n = self.tree.end[leaf] - self.tree.start[leaf]
        to = np.repeat(self.tree.start[leaf] - np.r_[0, n.cumsum()[:-1]], n) + np.arange(n.sum())
        who = np.repeat(who, n)
        close = np.bitwise_count(unary(vectors)[who] ^ self.bits[to]) <= (1 if longer else 2)
        who, to = who[close], to[close]
        a, b = letters[who], self.letters[to]
        if longer:
            run = lambda same: np.where(same.all(axis=1), same.shape[1], (~same).argmax(axis=1))
            ok = run(a[:, :-1] == b) + run((a[:, 1:] == b)[:, ::-1]) >= b.shape[1]
        else:
            ok = (a != b).sum(axis=1) == 1
        return who[ok], to[ok]


def _route(trees: dict[int, Tree]):
    """Each word as a point of its own cell and as an asker of the cells in reach."""

    def run(rows):
        for b in C.cut(rows, 20_000, 8 << 20):
            words = b.column(0)
            sizes = np.fromiter(map(len, words.to_pylist()), np.int64, len(words))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                mine = words.take(pa.array(at))
                vectors = counts(codes(mine.to_pylist())) if size in trees or size - 1 in trees else None
                for of, radius, asks in ((size, 0, False), (size, 2, True), (size - 1, 1, True)):
                    if of < LEAST_LENGTH:
                        continue
                    who, cell = trees[of].reach(vectors, radius) if of in trees else (np.arange(len(at)), np.zeros(len(at), np.int64))
                    for k in range(0, len(who), 20_000):
                        w = who[k : k + 20_000]
                        m = len(w)
                        yield pa.RecordBatch.from_arrays([pa.array([of] * m, pa.int32()), pa.array(cell[k : k + m], pa.int32()), pa.array([asks] * m), mine.take(pa.array(w)), b.column(1).take(pa.array(at[w]))], ["length", "cell", "asks", "word", "n"])

    return run


def _search(rows):
    """Rows sorted by cell, its points before its askers: near pairs, the asker first, for shorter points both ways."""
    key, points, ns, cell = None, [], [], None
    for b in C.batches(rows):
        lengths, cells, asks = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        change = np.flatnonzero((np.diff(lengths) != 0) | (np.diff(cells) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for start, end in zip(np.r_[0, change], np.r_[change, len(lengths)]):
            if (lengths[start], cells[start]) != key:
                key, points, ns, cell = (lengths[start], cells[start]), [], [], None
            words, n = b.column(3).slice(start, end - start), b.column(4).slice(start, end - start)
            if not asks[start]:
                points.append(words)
                ns.append(n)
                continue
            if not points:
                continue
            if cell is None:
                flat, flat_n = pa.concat_arrays(points), pa.concat_arrays(ns)
                cell = Cell(flat.to_pylist())
                order = pa.array(cell.tree.order)
                flat, flat_n = flat.take(order), flat_n.take(order)
            sizes = np.fromiter(map(len, words.to_pylist()), np.int64, len(words))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for k in range(0, len(at), ASKED):
                    mine = pa.array(at[k : k + ASKED])
                    some, some_n = words.take(mine), n.take(mine)
                    who, to = (pa.array(x) for x in cell.near(codes(some.to_pylist())))
                    if len(who):
                        one, two = (some.take(who), some_n.take(who)), (flat.take(to), flat_n.take(to))
                        for a, c in ((one, two), (two, one))[: 1 if size == key[0] else 2]:
                            yield pa.RecordBatch.from_arrays([a[0], c[0], c[1]], ["word", "near", "near_n"])


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with at least ``least`` occurrences."""
    counted = C.id_text(docs, id_col, text_col).mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def near_words(vocab: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, near, near_n): all ordered pairs of ``vocab`` (word, n) that are one edit apart."""
    size = F.length("word")
    total = vocab.count()
    cell = max(cell, -(-2 * total // CELLS))
    # lengths of more than a cell's words: fewer than CELLS / 2 of them, and at most CELLS cells
    large = {r["size"]: r["n"] for r in vocab.groupBy(size.alias("size")).agg(F.count("*").alias("n")).filter(F.col("n") > cell).collect()}
    trees = {}
    if large:
        every = F.create_map(*[F.lit(int(x)) for k, n in large.items() for x in (k, max(1, cell // SAMPLE))])[size]
        sample: dict[int, list[str]] = {k: [] for k in large}
        for r in vocab.filter(size.isin(list(large)) & (F.pmod(F.xxhash64("word"), every) == 0)).select("word").sort("word").collect():
            sample[len(r["word"])].append(r["word"])
        trees = {k: Tree(counts(codes(w)), leaf=max(1, len(w) * cell // large[k])) for k, w in sample.items() if w}
    n = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = vocab.mapInArrow(_route(trees), "length int, cell int, asks boolean, word string, n long")
    laid = routed.repartition(n, "length", "cell").sortWithinPartitions("length", "cell", "asks")
    return laid.mapInArrow(_search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the chain of forms ends, by doubling."""
    at = C.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots", most=C.LEAST_FILES)
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = at.join(on.hint("shuffle_hash"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        doubled = C.stored(doubled, "spelling-roots", most=C.files(at))
        at = doubled.select("word", "root")
        if not doubled.filter("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary."""
    vocab = C.stored(vocabulary(docs, id_col=id_col, text_col=text_col), "spelling-words", most=C.files(docs))
    nothing = vocab.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    rows = near_words(vocab, cell).select("word", F.lit(None).cast("long").alias("n"), "near", "near_n").unionByName(nothing)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))).alias("best")
    got = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    is_form = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    got = got.select("word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    got = C.stored(got, "spelling-forms", most=C.files(docs))
    ends = roots(got.filter("form IS NOT NULL"))
    return got.join(ends.hint("shuffle_hash"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``documents`` with at least seven letters and two occurrences.

    Null texts have no words; a null id counts as empty text; rows count as often as they come; an empty table gives no rows.
    """
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# crc32 bit by bit: the table of 256 entries from its rule, then one step for each byte
_STEP = "CASE WHEN {0} % 2 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
CRC_TABLE = """ct AS MATERIALIZED (SELECT list(v ORDER BY k) AS t FROM (
  WITH RECURSIVE b(k, i, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT k, i + 1, """ + _STEP.format("v") + """ FROM b WHERE i < 8)
  SELECT k, v FROM b WHERE i = 8))"""


def crc_sql(byte_list: str) -> str:
    """Unsigned crc32 of a list of bytes; ``t`` is the table in scope."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte_list}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


OP13_SQL = r"""
WITH RECURSIVE """ + CRC_TABLE + r""",
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, """ + crc_sql("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))") + r""" AS h FROM r, ct),
v AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM h),
c AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS MATERIALIZED (SELECT word, left(word, k) AS a, substr(word, k + 2) AS b FROM (SELECT word, unnest(range(length(word)))::INTEGER AS k FROM c)),
p AS (SELECT x.word, y.word AS near FROM g x JOIN g y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT g.word, c.word FROM g JOIN c ON c.word = g.a || g.b UNION SELECT c.word, g.word FROM g JOIN c ON c.word = g.a || g.b),
q AS (SELECT p.word, p.near, c.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY c.n DESC, encode(p.near)) AS k, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN c ON c.word = p.near),
f AS MATERIALIZED (SELECT c.word, c.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.near_n >= 10 * c.n THEN q.near END AS form, CASE WHEN q.near_n >= 10 * c.n THEN q.near_n END AS form_n FROM c LEFT JOIN q ON q.word = c.word AND q.k = 1),
s(word, o, i) AS (SELECT word, word, 0 FROM f UNION ALL SELECT s.word, f.form, s.i + 1 FROM s JOIN f ON f.word = s.o WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, max_by(o, i) AS root FROM s GROUP BY word) e ON e.word = f.word
"""
