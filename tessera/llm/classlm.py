"""Language-model scoring with Brown classes.

Texts are read once: a batch becomes its distinct words, once each, and its tokens as
indexes of these. Counts of all training words come from one packed exchange of the
distinct words; a receiver owns a range of word keys. The most frequent words (their number
and that of the classes grow with the vocabulary) are clustered by exchange (moves that raise the
likelihood of the class bigrams). Every other training word is then placed: its neighbours'
classes, counted over all training texts, meet at the word's receiver, which moves it from
the class of unplaced words to the class that raises the same likelihood most. So each training word has
a class, kept as a table by ranges of keys; the batches ask it for their own words. Only the
frequent words and the class matrix are sent to executors. A token's probability is that of
its class after the class before it, interpolated with the class's own frequency, times the word's
smoothed share of its class. Words that no training text holds, and the end token, have
classes of their own.

Words are told apart by 64-bit hashes.

Defined cases: null or empty text is the end token alone; with no training documents the
counts are zero; a null id counts as empty text in the fold; equal rows get equal scores;
empty tables give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import exchange as X

CLASSES, SWEEPS = 32, 4
PER_CLASS = 16  #: frequent words for each class; they are clustered first
FOLDS, HELD_OUT = 7, 2
INTERPOLATE = 10.0  #: weight of the class's own frequency against what follows a class
END = xxhash.xxh3_64_intdigest(b"")  #: no word is empty

BATCH = {"batch": pa.int64(), "keys": pa.binary(), "counts": pa.binary(), "tokens": pa.binary(), "sizes": pa.binary(), "ids": pa.binary(), "nulls": pa.binary(), "train": pa.binary()}
BATCH_SQL = "batch long, keys binary, counts binary, tokens binary, sizes binary, ids binary, nulls binary, train binary"
COUNT = {"bucket": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
COUNT_SQL = "bucket int, keys binary, counts binary"
CONTEXT = {"bucket": pa.int32(), "keys": pa.binary(), "sizes": pa.binary(), "places": pa.binary(), "counts": pa.binary()}
CONTEXT_SQL = "bucket int, keys binary, sizes binary, places binary, counts binary"
TABLE = {"bucket": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "classes": pa.binary()}
TABLE_SQL = "bucket int, keys binary, counts binary, classes binary"
MEET = {"bucket": pa.int32(), "kind": pa.int32(), "batch": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "classes": pa.binary()}
MEET_SQL = "bucket int, kind int, batch long, part int, keys binary, counts binary, classes binary"
REPLY = {"batch": pa.int64(), "part": pa.int32(), "counts": pa.binary(), "classes": pa.binary()}
REPLY_SQL = "batch long, part int, counts binary, classes binary"
CODED = {"classes": pa.binary(), "sizes": pa.binary(), "ids": pa.binary(), "nulls": pa.binary(), "train": pa.binary(), "logs": pa.binary(), "known": pa.binary()}
CODED_SQL = "classes binary, sizes binary, ids binary, nulls binary, train binary, logs binary, known binary"


def n_classes(n_words: int) -> int:
    """Classes for a vocabulary: its cube root, at least CLASSES."""
    return max(CLASSES, round(n_words ** (1 / 3)))


def _pack(values: np.ndarray) -> bytes:
    """Non-negative ints below 2^32, byte by byte of all values, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _encode(rows):
    known = C.WordHash()
    for b in C.cut(rows, 20_000, 8 << 20):
        train = b.column(2).to_numpy(zero_copy_only=False)
        found = [np.append(known.of(t.lower().split()), np.uint64(END)) for t in C.texts(b.column(1))]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        keys, of, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        by = np.argsort(-times, kind="stable")  # frequent words get small indexes
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        tokens = rank[of]
        counts = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(by))
        packed = (uuid.uuid4().int >> 65, keys[by].tobytes(), X.small(counts), _pack(tokens), _pack(sizes), C.ids(b.column(0)).tobytes(), np.packbits(b.column(0).is_null().to_numpy(zero_copy_only=False)).tobytes(), np.packbits(train).tobytes())
        yield X.rows_of({c: [v] for c, v in zip(BATCH, packed)}, BATCH)


def _ship_counts(n: int, labels: np.ndarray):
    def run(rows):
        for b in C.batches(rows):
            for keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                keys = np.frombuffer(keys, np.uint64)
                counts = X.unsmall(counts, len(keys))
                keys, counts = keys[counts > 0], counts[counts > 0]
                to = X.bucket(keys, n)
                sort = np.argsort(to, kind="stable")
                out = {c: [] for c in COUNT}
                for value, lo, hi in X.slices(to[sort]):
                    sel = sort[lo:hi]
                    for c, v in zip(COUNT, (int(labels[value]), keys[sel].tobytes(), X.small(counts[sel]))):
                        out[c].append(v)
                yield X.rows_of(out, COUNT)

    return run


def _count(rows):
    got: dict[int, list] = {}
    for b in C.batches(rows):
        for bucket, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
            keys = np.frombuffer(keys, np.uint64)
            got.setdefault(bucket, []).append((keys, X.unsmall(counts, len(keys)).astype(np.int32)))
    for bucket, parts in got.items():
        words, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(of, np.concatenate([c for _, c in parts]), len(words)).astype(np.int64)
        yield X.rows_of({"bucket": [bucket], "keys": [words.tobytes()], "counts": [counts.tobytes()]}, COUNT)


def _sizes(rows):
    for b in C.batches(rows):
        counts = [np.frombuffer(c, np.int64) for c in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([len(c) for c in counts], pa.int64())], ["tokens", "words"])


def _most(top: int):
    def run(rows):
        for b in C.batches(rows):
            for keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                best = np.lexsort((keys.view(np.int64), -counts))[: top + 1]
                yield pa.RecordBatch.from_arrays([pa.array(keys[best].view(np.int64)), pa.array(counts[best])], ["key", "n"])

    return run


class Frequent:
    """The most frequent words by key; ``end`` follows them."""

    def __init__(self, keys: list[int], counts: np.ndarray):
        self.size = len(keys)
        all_keys = np.array([*keys, END], np.uint64)
        self.by = np.argsort(all_keys)
        self.keys, self.counts = all_keys[self.by], counts

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of keys: a frequent word's own, size for the rest, size + 1 for the end."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        own = np.where(self.by == self.size, self.size + 1, self.by)
        return np.where(self.keys[at] == keys, own[at], self.size)


SLABS, SPREAD = 4, 8


def _merge(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    c, of = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(of, np.concatenate(counts), len(c)).astype(np.int64)


def _pairs(tokens_of, m: int):
    """Counts of the codes (token * m + next token) of a task's training texts; ``tokens_of`` reads a packed row."""

    def run(rows):
        codes, counts, held = [], [], 0
        for b in C.batches(rows):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                tokens = np.r_[m - 1, tokens_of(*row)]  # a text begins after an end
                c, k = np.unique(tokens[:-1] * m + tokens[1:], return_counts=True)
                codes.append(c)
                counts.append(k)
                held += len(c)
                if held > 4_000_000 and len(codes) > 1:
                    c, k = _merge(codes, counts)
                    codes, counts, held = [c], [k], 0
        if codes:
            yield from _slabs(*_merge(codes, counts), m, np.random.default_rng(int(held)).integers(SPREAD))

    return run


def _slabs(codes: np.ndarray, counts: np.ndarray, m: int, spread: int):
    for slab, lo, hi in X.slices(codes // m * SLABS // m):
        yield _slab(slab, spread, codes[lo:hi], counts[lo:hi])


def _slab(slab: int, spread: int, codes: np.ndarray, counts: np.ndarray):
    packed = (pa.array([zstandard.compress(x.tobytes(), 1)], pa.binary()) for x in (codes, counts))
    return pa.RecordBatch.from_arrays([pa.array([int(slab)], pa.int32()), pa.array([int(spread)], pa.int32()), *packed], ["slab", "spread", "codes", "counts"])


def _unslab(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(zstandard.decompress(x), np.int64) for x in (codes, counts))


def _add(last: bool):
    def run(rows):
        sums: dict = {}
        for b in C.batches(rows):
            for slab, spread, *packed in zip(*(c.to_pylist() for c in b.columns)):
                at, (codes, counts) = (slab, 0 if last else spread), _unslab(*packed)
                sums[at] = _merge([sums[at][0], codes], [sums[at][1], counts]) if at in sums else (codes, counts)
        for (slab, spread), (codes, counts) in sums.items():
            yield _slab(slab, spread, codes, counts)

    return run


def pair_matrix(packed: DataFrame, tokens_of, m: int) -> np.ndarray:
    """Counts of (token, next token) over all training texts."""
    schema = "slab int, spread int, codes binary, counts binary"
    parts = packed.mapInArrow(_pairs(tokens_of, m), schema)
    parts = parts.repartition(SLABS * SPREAD, "slab", "spread").mapInArrow(_add(False), schema)
    parts = parts.repartition(SLABS, "slab").mapInArrow(_add(True), schema).collect()
    out = np.zeros(m * m, np.int64)
    for r in parts:
        codes, counts = _unslab(r["codes"], r["counts"])
        out[codes] += counts
    return out.reshape(m, m)


def _frequent_tokens(shared):
    def run(keys, tokens, sizes, train):
        lut, sizes = shared.value.of(np.frombuffer(keys, np.uint64)), _unpack(sizes)
        return lut[_unpack(tokens)[np.repeat(_bits(train, len(sizes)), sizes)]]

    return run


def _coded_tokens(classes, sizes, train):
    sizes = _unpack(sizes)
    return _unpack(classes)[np.repeat(_bits(train, len(sizes)), sizes)]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def cluster(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each token by exchange: words move, one at a time, to the class that raises the likelihood most.

    The last two tokens (other, end) keep classes of their own, the last two.
    """
    m = len(bigrams)
    words, k = m - 2, max(1, min(classes, m - 2))
    of = np.r_[np.arange(words) % k, k, k + 1]
    n = bigrams.astype(float)
    member = np.zeros((m, k + 2))
    member[np.arange(m), of] = 1
    g = member.T @ n @ member
    out_w, in_w = n.sum(axis=1), n.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            old, s = of[w], n[w, w]
            r, q = n[w] @ member, n[:, w] @ member
            r[old] -= s
            q[old] -= s
            g[old] -= r
            g[:, old] -= q
            g[old, old] -= s
            left, right = g.sum(axis=1), g.sum(axis=0)
            f = _xlogx(g)
            row = _xlogx(g + r) - f
            col = _xlogx(g + q[:, None]) - f
            d = np.diagonal
            gain = row.sum(axis=1) - d(row) + col.sum(axis=0) - d(col) + _xlogx(d(g) + r + q + s) - d(f)
            gain -= _xlogx(left + out_w[w]) - _xlogx(left) + _xlogx(right + in_w[w]) - _xlogx(right)
            new = int(gain[:k].argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            member[w, old], member[w, new], of[w] = 0, 1, new
            g[new] += r
            g[:, new] += q
            g[new, new] += s
        if not moved:
            break
    return of


def _ship_contexts(shared, n: int, labels: np.ndarray):
    """The classes before and after each training token that is not a frequent word, by word."""

    def run(rows):
        frequent, of = shared.value
        k = int(of.max()) + 1
        for b in C.batches(rows):
            for keys, tokens, sizes, train in zip(*(c.to_pylist() for c in b.columns)):
                keys, sizes = np.frombuffer(keys, np.uint64), _unpack(sizes)
                tokens = _unpack(tokens)[np.repeat(_bits(train, len(sizes)), sizes)]
                index = frequent.of(keys)
                at = np.flatnonzero(index[tokens] == frequent.size)
                c = of[index][tokens]
                # each text ends with an end token, so a rest word always has a token after it
                before = np.where(at > 0, c[at - 1], k - 1)
                code = tokens[at] * (2 * k)
                code, counts = np.unique(np.concatenate([code + before, code + k + c[np.minimum(at + 1, len(c) - 1)]]), return_counts=True)
                word, place = code // (2 * k), code % (2 * k)
                to = X.bucket(keys[word], n)
                sort = np.argsort(to, kind="stable")
                out = {c: [] for c in CONTEXT}
                for value, lo, hi in X.slices(to[sort]):
                    w = word[sort[lo:hi]]
                    first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                    packed = (int(labels[value]), keys[w[first]].tobytes(), _pack(np.diff(np.r_[first, len(w)])), place[sort[lo:hi]].astype(np.uint16).tobytes(), X.small(counts[sort[lo:hi]]))
                    for c_, v in zip(CONTEXT, packed):
                        out[c_].append(v)
                yield X.rows_of(out, CONTEXT)

    return run


class Placing:
    """The class of the frequent words' clustering that a word's neighbours fit best, by the gain of ``cluster``."""

    TABLED = 8  #: gains of counts up to this are looked up

    def __init__(self, g: np.ndarray):
        self.g, self.k = g.astype(float), len(g)
        # [place]: what adding to g[c, place] gives each class c; places are classes before, then classes after
        self.base = np.concatenate([self.g, self.g.T])
        f = _xlogx(self.base)
        self.table = np.stack([_xlogx(self.base + c) - f for c in range(self.TABLED + 1)])
        self.left, self.right, self.diagonal = self.g.sum(axis=1), self.g.sum(axis=0), np.diagonal(self.g)

    def of(self, first: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Classes of words; the entries of a word begin at ``first``."""
        out, ends = np.zeros(len(first), np.uint16), np.r_[first[1:], len(places)]
        lo = 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + 20_000, "right")))
            a, b = first[lo], ends[hi - 1]
            out[lo:hi] = self._some(first[lo:hi] - a, places[a:b], counts[a:b])
            lo = hi
        return out

    def _some(self, first, places, counts):
        k = self.k
        gain = self.table[np.minimum(counts, self.TABLED), places]
        big = np.flatnonzero(counts > self.TABLED)
        gain[big] = _xlogx(self.base[places[big]] + counts[big, None]) - _xlogx(self.base[places[big]])
        total = np.add.reduceat(gain, first, axis=0)
        word = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(places)]))
        at = np.bincount(word * (2 * k) + places, counts, len(first) * 2 * k).reshape(-1, 2, k)
        q, r = at[:, 0], at[:, 1]  # before a word, after it
        n = q.sum(axis=1, keepdims=True)
        d, f = self.diagonal, _xlogx(self.diagonal)
        total += _xlogx(d + q + r) - _xlogx(d + q) - _xlogx(d + r) + f  # both at once on the diagonal
        # the matrix still counts the word's neighbours under the class of unplaced words
        rest = k - 2
        for line, away, back in ((self.g[rest], r, q), (self.g[:, rest], q, r)):
            less, more = line - away, back[:, rest, None]
            total += _xlogx(less + more) - _xlogx(less) - _xlogx(line + more) + _xlogx(line)
        total -= _xlogx(self.left + n) - _xlogx(self.left) + _xlogx(self.right + n) - _xlogx(self.right)
        return total[:, : k - 2].argmax(axis=1)


def _place(shared):
    def run(rows):
        placing, got = shared.value, {}
        for b in C.batches(rows):
            for bucket, keys, sizes, places, counts in zip(*(c.to_pylist() for c in b.columns)):
                places = np.frombuffer(places, np.uint16)
                got.setdefault(bucket, []).append((np.frombuffer(keys, np.uint64), _unpack(sizes), places, X.unsmall(counts, len(places)).astype(np.int32)))
        for bucket in list(got):
            parts = got.pop(bucket)
            words, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            code = np.repeat(of, np.concatenate([p[1] for p in parts])) * (2 * placing.k) + np.concatenate([p[2] for p in parts])
            code, counts = _merge([code], [np.concatenate([p[3] for p in parts])])
            word, places = code // (2 * placing.k), code % (2 * placing.k)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            classes = placing.of(first, places, counts)
            before = np.bincount(word, np.where(places < placing.k, counts, 0), len(words)).astype(np.int64)
            yield X.rows_of({"bucket": [bucket], "keys": [words.tobytes()], "counts": [before.tobytes()], "classes": [classes.tobytes()]}, TABLE)

    return run


def _masses(rows):
    for b in C.batches(rows):
        for counts, classes in zip(*(c.to_pylist() for c in b.columns)):
            classes = np.frombuffer(classes, np.uint16)
            size, mass = np.bincount(classes), np.bincount(classes, np.frombuffer(counts, np.int64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(size))), pa.array(mass), pa.array(size.astype(np.int64))], ["class", "mass", "size"])


def _rest(frequent: Frequent, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent indexes of a batch's keys; the other ones' positions by bucket, and their buckets."""
    index = frequent.of(keys)
    rest = np.flatnonzero(index == frequent.size)
    to = X.bucket(keys[rest], n)
    sort = np.argsort(to, kind="stable")
    return index, rest[sort], to[sort]


def _ask(shared, n: int, labels: np.ndarray):
    def run(rows):
        frequent, _ = shared.value
        for b in C.batches(rows):
            for batch, keys in zip(*(c.to_pylist() for c in b.columns)):
                keys = np.frombuffer(keys, np.uint64)
                _, rest, to = _rest(frequent, keys, n)
                out = {c: [] for c in MEET}
                for value, lo, hi in X.slices(to):
                    for c, v in zip(MEET, (int(labels[value]), 1, batch, value, keys[rest[lo:hi]].tobytes(), None, None)):
                        out[c].append(v)
                yield X.rows_of(out, MEET)

    return run


def _reply(unseen: int):
    def run(rows):
        at, table = None, None
        for b in C.batches(rows):
            out = {c: [] for c in REPLY}
            for bucket, kind, batch, part, keys, counts, classes in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != at:
                    at, table = bucket, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16))
                keys = np.frombuffer(keys, np.uint64)
                if kind == 0:
                    table = (keys, np.frombuffer(counts, np.int64), np.frombuffer(classes, np.uint16))
                    continue
                n, c = np.zeros(len(keys), np.int64), np.full(len(keys), unseen, np.uint16)
                if len(table[0]):
                    where = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
                    hit = table[0][where] == keys
                    n[hit], c[hit] = table[1][where[hit]], table[2][where[hit]]
                for k, v in zip(REPLY, (batch, part, X.small(n), c.tobytes())):
                    out[k].append(v)
            if out["batch"]:
                yield X.rows_of(out, REPLY)

    return run


def _code(shared, n: int, ends: int):
    """The classes of a batch's tokens, and each text's sum of log10(c + 1) and number of known tokens."""

    def run(rows):
        frequent, of = shared.value
        replies: list = []
        for b in C.batches(rows):
            names = b.schema.names
            for row in zip(*(c.to_pylist() for c in b.columns)):
                r = dict(zip(names, row))
                if r["kind"] == 0:
                    replies.append((r["part"], r["counts"], r["classes"]))
                    continue
                keys = np.frombuffer(r["keys"], np.uint64)
                index, rest, to = _rest(frequent, keys, n)
                classes = of[index]
                counts = np.r_[frequent.counts, 0, ends][index]
                got = {part: (a, c) for part, a, c in replies}
                replies = []
                for value, lo, hi in X.slices(to):
                    raw, c = got[value]
                    counts[rest[lo:hi]], classes[rest[lo:hi]] = X.unsmall(raw, hi - lo), np.frombuffer(c, np.uint16)
                sizes, tokens = _unpack(r["sizes"]), _unpack(r["tokens"])
                first = np.cumsum(sizes) - sizes
                logs = np.add.reduceat(np.log10(counts + 1.0)[tokens], first)
                known = np.add.reduceat((counts > 0).astype(np.int64)[tokens], first)
                packed = (_pack(classes[tokens]), r["sizes"], r["ids"], r["nulls"], r["train"], logs.tobytes(), _pack(known))
                yield X.rows_of({c: [v] for c, v in zip(CODED, packed)}, CODED)

    return run


def transitions(g: np.ndarray) -> np.ndarray:
    """log10 of the probabilities of a class after a class, from the counts of class bigrams."""
    share = (g.sum(axis=0) + 1) / (g.sum() + len(g))
    return np.log10((g + INTERPOLATE * share) / (g.sum(axis=1, keepdims=True) + INTERPOLATE))


def weights(mass: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log10 of what a word's count + 1 is divided by in each class: one more word than seen, as in the base score."""
    return np.log10(mass + size + 1)


class Model:
    """Clustering of the frequent words: classes, and log10 probabilities of class transitions and of words in classes among themselves."""

    def __init__(self, keys: list[int], counts: np.ndarray, bigrams: np.ndarray, n_tokens: int, n_words: int, classes: int = CLASSES):
        self.keys, self.n_tokens, self.n_words = keys, n_tokens, n_words
        m = len(bigrams)
        self.of = cluster(bigrams, classes)
        k = self.of.max() + 1
        member = np.zeros((m, k))
        member[np.arange(m), self.of] = 1
        self.classes = member.T @ bigrams @ member
        self.after = transitions(self.classes)
        words = self.of[:-2]
        self.size = np.bincount(words, minlength=k)
        self.mass = np.bincount(words, counts[: m - 2], minlength=k)
        self.emit = np.zeros(m)
        self.emit[: m - 2] = np.log10(counts[: m - 2] + 1) - weights(self.mass, self.size)[words]


def _score(shared):
    def run(rows):
        after, weight = shared.value
        for b in C.batches(rows):
            for classes, sizes, ids, nulls, train, logs, known in zip(*(c.to_pylist() for c in b.columns)):
                c, sizes = _unpack(classes), _unpack(sizes)
                # every text ends with an end token, so each begins after one
                steps = after[np.r_[c[-1], c[:-1]], c] - weight[c]
                fixed = np.add.reduceat(steps, np.cumsum(sizes) - sizes)
                ids = pa.array(np.frombuffer(ids, np.int64), mask=_bits(nulls, len(sizes)))
                logs = np.frombuffer(logs, np.float64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(_bits(train, len(sizes))), pa.array(sizes), pa.array(_unpack(known)), pa.array(logs), pa.array(fixed + logs)], ["doc_id", "train", "n_tokens", "known", "log_counts", "score"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Word counts, classes and coded texts: ``batches``, ``table`` (the words that are not frequent), ``frequent``, ``model``, sizes."""
    d = C.id_text(docs, id_col, text_col)
    sc = docs.sparkSession.sparkContext
    n = X.groups(d)
    labels = X.labels(n)
    d = d.withColumn("train", C.fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    batches = C.stored(d.select("doc_id", "text", "train").mapInArrow(_encode, BATCH_SQL), "lm-batches")
    shipped = batches.select("keys", "counts").mapInArrow(_ship_counts(n, labels), COUNT_SQL).repartition(n, "bucket")
    words = C.stored(shipped.mapInArrow(_count, COUNT_SQL), "lm-counts")
    size = words.select("counts").mapInArrow(_sizes, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    n_tokens, n_words = size[0] or 0, size[1] or 0
    classes = n_classes(n_words)
    top = classes * PER_CLASS
    tops = words.select("keys", "counts").mapInArrow(_most(top), "key long, n long").orderBy(F.desc("n"), "key").limit(top + 1).collect()
    ends = sum(r["n"] for r in tops if r["key"] == _signed(END))
    if not ends and n_tokens:
        raise AssertionError("a training text has an end")
    best = [r for r in tops if r["key"] != _signed(END)][:top]
    keys, counts = [r["key"] % (1 << 64) for r in best], np.array([r["n"] for r in best], np.int64)
    frequent = Frequent(keys, counts)
    bigrams = pair_matrix(batches.select("keys", "tokens", "sizes", "train"), _frequent_tokens(sc.broadcast(frequent)), len(keys) + 2)
    model = Model(keys, counts.astype(float), bigrams, n_tokens, n_words, classes)
    shared, placing = sc.broadcast((frequent, model.of)), sc.broadcast(Placing(model.classes))
    contexts = batches.select("keys", "tokens", "sizes", "train").mapInArrow(_ship_contexts(shared, n, labels), CONTEXT_SQL).repartition(n, "bucket")
    table = C.stored(contexts.mapInArrow(_place(placing), TABLE_SQL), "lm-classes")
    return {"batches": batches, "table": table, "frequent": shared, "model": model, "ends": ends, "n": n, "labels": labels}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text."""
    got = fit(docs, id_col, text_col)
    batches, table, shared, model, n = (got[k] for k in ("batches", "table", "frequent", "model", "n"))
    k = len(model.classes)
    asked = batches.select("batch", "keys").mapInArrow(_ask(shared, n, got["labels"]), MEET_SQL)
    told = table.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("part"), "keys", "counts", "classes")
    meet = told.unionByName(asked).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    replies = meet.mapInArrow(_reply(k - 2), REPLY_SQL).withColumn("kind", F.lit(0))
    texts = batches.drop("counts").withColumn("kind", F.lit(1))
    both = replies.unionByName(texts, allowMissingColumns=True).repartition(n, "batch").sortWithinPartitions("batch", "kind")
    coded = C.stored(both.mapInArrow(_code(shared, n, got["ends"]), CODED_SQL), "lm-coded")
    mass, size = model.mass.astype(float), model.size.astype(float)
    for r in table.select("counts", "classes").mapInArrow(_masses, "class long, mass long, size long").groupBy("class").agg(F.sum("mass").alias("mass"), F.sum("size").alias("size")).collect():
        mass[r["class"]] += r["mass"]
        size[r["class"]] += r["size"]
    weight = weights(mass, size)
    weight[k - 1] = np.log10(got["ends"] + 1)  # the end token is its whole class
    g = pair_matrix(coded.select("classes", "sizes", "train"), _coded_tokens, k)
    final = docs.sparkSession.sparkContext.broadcast((transitions(g), weight))
    scored = coded.select(*CODED).mapInArrow(_score(final), "doc_id long, train boolean, n_tokens long, known long, log_counts double, score double")
    unit = float(np.log10(model.n_tokens + model.n_words + 1))
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def op8_class_lm(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of ``documents``.

    Null text is the end token alone; null ids stay null and count as empty text in the fold; rows repeat as they came; an
    empty table gives no rows.
    """
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
