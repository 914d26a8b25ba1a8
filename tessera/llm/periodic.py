"""Periodic runs of words: maximal repetitions found by suffix trees of a text and of its reversal.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no neighbour extends.

1. Stretches that can hold runs: in a run each three consecutive words occur at least three times, so
   words of rarer triples part the text; what is left is counted anew until nothing more falls away.
   No run is lost or cut by this, and prose seldom keeps anything.
2. Ukkonen's algorithm builds the suffix trees of each stretch and of its reversal. Leaves in depth-first
   order give the ranks of suffixes; the lowest depth that the Euler tour passes between two leaves is
   that of their lowest common ancestor, so the depths at the tour's turning points and a sparse table of their minima answer longest common
   extensions in constant time.
3. Every run has, for one of the two orders of the alphabet, a Lyndon root that is the longest Lyndon
   word from its start, and that ends before the next smaller suffix. These candidates, two a word, are extended to both
   sides, those long enough are the runs.

A task reads its own texts, without any shuffle; memory follows the longest stretch of one text (about 300 bytes a word of it).

Defined cases: null or empty text has no words and no run; a null id is empty text where ids are
hashed; equal rows give equal results; ties between best runs go to the smallest start, then the smallest period; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common as C
from tessera.llm.spelling import CRC_TABLE, crc_sql

LEAST, TIMES = 6, 4  #: a run has at least LEAST words and TIMES periods


class SuffixTree:
    """Ukkonen's tree of a list of symbols (1 and more); the end symbol 0 is added."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        n, k = len(s), max(s) + 1
        start, end, link, edge = array("i", [0]), array("i", [0]), array("i", [0]), {}
        node = at = length = left = 0
        for i, c in enumerate(s):
            left += 1
            waits = 0
            while left:
                if not length:
                    at = i
                key = node * k + s[at]
                to = edge.get(key)
                if to is None:
                    edge[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    first = start[to]
                    size = end[to] - first
                    if length >= size:
                        node, at, length = to, at + size, length - size
                        continue
                    if s[first + length] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    new = len(start)
                    edge[key] = new
                    start.append(first)
                    end.append(first + length)
                    link.append(0)
                    edge[new * k + c] = new + 1
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    start[to] = first + length
                    edge[new * k + s[first + length]] = to
                    if waits:
                        link[waits] = new
                    waits = new
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - left + 1
        self.n, self.start, self.end = n, np.array(start), np.array(end)
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        self.child = np.fromiter(edge.values(), np.int64, len(edge))
        self.parent, self.symbol = keys // k, keys % k
        self.k = k

    def leaves(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of their leaves, and the depth the Euler tour falls back to before each.

        With ``falling`` the alphabet is reversed, the end symbol staying the smallest.
        """
        symbol = (self.k - self.symbol) % self.k if falling else self.symbol
        order = np.lexsort((symbol, self.parent))
        of, child = self.parent[order], self.child[order].tolist()
        # edges of each node lie side by side; a node without any is a leaf
        first = np.searchsorted(of, np.arange(len(self.start) + 1)).tolist()
        size = (self.end - self.start).tolist()
        out, back, low, n = array("i"), array("i"), 0, self.n
        stack = [(0, 0, 0)]  # node, depth of its parent, depth the tour fell back to (-1: none, a first child)
        while stack:
            node, depth, fell = stack.pop()
            if fell >= 0:
                low = fell
            depth += size[node]
            a, b = first[node], first[node + 1]
            if a == b:
                out.append(n - depth)
                back.append(low)
            else:
                for j in range(b - 1, a, -1):
                    stack.append((child[j], depth, depth))
                stack.append((child[a], depth, -1))
        return np.array(out), np.array(back)


class Extensions:
    """Longest common extensions of suffixes by minima over the Euler tour's turning points."""

    def __init__(self, leaves: np.ndarray, back: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.minima = [back.astype(np.int32)]
        while 2 << len(self.minima) - 1 <= len(back):
            a, half = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(a[:-half], a[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes from i and from j (different ones) have in common."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k) + 1])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place but the last the next one of smaller rank; the last has the smallest."""
    out, stack = [0] * (len(rank) - 1), [len(rank) - 1]
    for i in range(len(rank) - 2, -1, -1):
        r = rank[i]
        while rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return out


def tree_runs(symbols: list[int]) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of symbols (1 and more)."""
    n = len(symbols)
    tree = SuffixTree(symbols)
    leaves, back = tree.leaves()
    right = Extensions(leaves, back)
    falling, _ = tree.leaves(falling=True)
    del tree
    other = np.empty(n + 1, np.int64)
    other[falling] = np.arange(n + 1)
    i = np.r_[np.arange(n), np.arange(n)]
    p = np.array(_next_smaller(right.rank.tolist()) + _next_smaller(other.tolist())) - i
    some = i + p < n
    pairs = np.unique(i[some] * (n + 1) + p[some])
    i, p = pairs // (n + 1), pairs % (n + 1)
    after = right(i, i + p)
    del right
    before = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left = Extensions(*SuffixTree(symbols[::-1]).leaves())
    before[inner] = left(n - i[inner], n - i[inner] - p[inner])
    start, length = i - before, before + p + after
    long = length >= np.maximum(LEAST, TIMES * p)
    return set(zip(start[long].tolist(), length[long].tolist(), p[long].tolist()))


def stretches(h: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words (from, to) that can hold runs: all their triples occur at least three times in them."""
    out, todo = [], [(0, len(h))]
    triples = C.windows(h, 3)
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        _, of, n = np.unique(triples[a : b - 2], return_inverse=True, return_counts=True)
        often = n[of] >= 3
        if often.all():
            out.append((a, b))
            continue
        edges = np.flatnonzero(np.diff(np.r_[0, often.astype(np.int8), 0])).tolist()
        todo += [(a + x, a + y + 2) for x, y in zip(edges[::2], edges[1::2])]
    return out


def runs(words: list[bytes], h: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period; ``h`` are hashes of the words."""
    out = []
    for a, b in stretches(h):
        ids: dict[bytes, int] = {}
        symbols = [ids.setdefault(w, len(ids) + 1) for w in words[a:b]]
        out += [(a + start, length, period) for start, length, period in tree_runs(symbols)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, of one in ten with a periodic tail."""
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats."""
    if not found:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[k] for k in np.flatnonzero(cover.cumsum()[:-1] == 0).tolist()]


SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _find(prepare):
    def run(rows):
        known = C.WordHash()
        for b in C.cut(rows, 2000, 8 << 20):
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), C.texts(b.column(1))):
                words = prepare(C.words(text, lower=False), doc_id)
                found = runs(words, known.of(words)) if len(words) >= LEAST else []
                best = None
                for r in found:  # by start, then period: the first of the greatest exponents stays
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
                sha = lambda x: hashlib.sha256(x).hexdigest()
                out.append((doc_id, len(words), len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(b" ".join(kept(words, found)))))
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def periodic_runs(docs: DataFrame, prepare=lambda words, doc_id: words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_runs, the run of greatest exponent, and digests of all runs and of the collapsed text."""
    return C.id_text(docs, id_col, text_col).mapInArrow(_find(prepare), SCHEMA)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, text): the runs as structs (start, length, period) and the text's words without what runs repeat; null text stays null."""

    def run(rows):
        known = C.WordHash()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in C.cut(rows, 2000, 8 << 20):
            found, texts = [], []
            for text in b.column(1).to_pylist():
                words = C.words((text or "").encode(), lower=False)
                got = runs(words, known.of(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in got])
                texts.append(None if text is None else text if not got else b" ".join(kept(words, got)).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "text"])

    return C.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_runs, the best run (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256 of every row of ``documents``.

    Null text has no words; without runs four fields are null and the digests those of nothing and of the whole text; null ids stay
    null; rows repeat as they came; an empty table gives no rows.
    """
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewritten)


OP12_SQL = r"""
WITH """ + CRC_TABLE + r""",
d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, """ + crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)") + r""" AS h FROM documents, ct),
k AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) ELSE len(ws) END AS a FROM d),
e AS (SELECT doc_id, n, list_concat(ws[1 : a], list_transform(range(n - a), lambda j: ws[a + 1 + j % (1 + (n - a) // (3 + g % 8))])) AS ws FROM k),
t AS MATERIALIZED (SELECT doc_id, i, hash(ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) AS g FROM (SELECT doc_id, ws, unnest(range(n - 2)) AS i FROM e WHERE n >= 6)),
o AS MATERIALIZED (SELECT t.* FROM t JOIN (SELECT doc_id, g FROM t GROUP BY ALL HAVING count(*) >= 3) USING (doc_id, g)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i),
b AS (SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS l FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM m) GROUP BY doc_id, q, z HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT doc_id, s, l, q FROM b WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = b.doc_id AND c.q < b.q AND c.s <= b.s AND c.s + c.l >= b.s + b.l)),
f AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM r GROUP BY doc_id),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) AS k FROM r) WHERE k = 1),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
y AS (SELECT doc_id, sha256(coalesce(string_agg(w, ' ' ORDER BY i), '')) AS c FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(n)) AS i FROM e) p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = p.doc_id AND x.i = p.i) GROUP BY doc_id)
SELECT e.doc_id, e.n AS n_words, coalesce(n_runs, 0) AS n_runs, u.s AS start, u.l AS length, u.q AS period, 1000 * u.l // u.q AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(y.c, sha256('')) AS collapsed_sha256
FROM e LEFT JOIN f ON f.doc_id = e.doc_id LEFT JOIN u ON u.doc_id = e.doc_id LEFT JOIN y ON y.doc_id = e.doc_id
"""
