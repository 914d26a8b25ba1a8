"""Exact repeated passages of words: suffix trees partitioned by prefixes of variable length.

Every suffix of a document's words matters down to a depth of ``depth`` words: two places share an internal
node at least that deep exactly if their first ``depth`` words are equal.

1. Pruning. A window of ``depth`` words holds an anchor, the run of ANCHOR words with the least hash. Where an
   anchor's run occurs once in the corpus, no suffix that holds it in its first ``depth`` words can lie below a
   deep node. Anchors meet by hash; all other suffixes, in long stretches, stay, with the words of their stretches.
   Stretches with the same least anchor, as copies have, are laid side by side; where too many have one they are dealt out.
2. Prefixes. All suffixes that stay are counted by the hash of their first word; where more than a part of a
   task's share have one, by that of their first two, and so on. A suffix's group is its shortest prefix
   that few enough share, at last its whole ``depth`` words, so groups fit in memory and equal suffixes share one.
3. Trees. A task gets the words of its groups' suffixes (a dictionary and indexes), sorts them by their words, and
   takes the common prefixes of neighbours: each run of neighbours that share ``depth`` words or more is a deep
   internal node. All its leaves but the earliest (smallest id, then smallest start) are repeats; adjacent repeats
   of a document join to maximal spans. Words are compared themselves here, not hashes.

Hot passages: of equal suffixes in a batch only the earliest is sent, the others are repeats already; of equal
anchors one is sent. Texts go to the first and last stage by id, compressed, and meet the flags of their own document only.

Documents are told apart by their ids. Where an id has several texts (nulls count as one id), the
distinct rows are numbered in order first, over ranges of rows, and go by their numbers.

Defined cases: null or empty text has no words, its kept text is empty; documents
shorter than a window keep all words; a null id sorts before all others; rows of one id with
different texts are documents of their own, in the order of a hash of their texts; equal rows give
equal results; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import exchange as X

DEPTH, ANCHOR = 20, 8
LENGTHS = (1, 2, 3, 5, 8, 13)  #: words of the prefixes that are tried before all ``depth``
GROUP = 800_000  #: suffixes behind one task
CELLS = 8  #: hash cells a task's share, by which prefixes are counted
SHIP = {"bucket": pa.int32(), "n": pa.int32(), "keys": pa.binary(), "ids": pa.binary(), "counts": pa.binary(), "steps": pa.binary()}
SHIP_SQL = "bucket int, n int, keys binary, ids binary, counts binary, steps binary"
SUFFIX = {"bucket": pa.int32(), "n": pa.int32(), "words": pa.binary(), "index": pa.binary(), "ids": pa.binary(), "counts": pa.binary(), "steps": pa.binary()}
SUFFIX_SQL = "bucket int, n int, words binary, index binary, ids binary, counts binary, steps binary"
MEET = {"part": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
MEET_SQL = "part int, kind int, blob binary"
_FEW = 4 << 20  #: bytes of text in a batch


def _places(at: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> dict:
    """Entries sorted by document and position, packed: ids, entries of each, steps between positions."""
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    steps = np.diff(pos, prepend=0)
    steps[first] = pos[first]
    return {"ids": ids[at[first]].tobytes(), "counts": X.small(np.diff(np.r_[first, len(at)])), "steps": X.small(steps)}


def _unplace(n: int, ids: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    docs = np.frombuffer(ids, np.int64)
    counts = X.unsmall(counts, len(docs))
    total = X.unsmall(steps, n).cumsum()
    first = np.r_[0, counts.cumsum()[:-1]].astype(np.int64)
    before = np.r_[0, total][first]
    return np.repeat(docs, counts), total - np.repeat(before, counts)


def anchors(h: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ANCHOR words, and for each window of ``depth`` words the place of its least one (the first of equal ones)."""
    k = min(ANCHOR, depth)
    keys = C.windows(h, k)
    n, span = len(h) - depth + 1, depth - k + 1
    if n < 1:
        return keys, np.zeros(0, np.int64)
    if len(keys) >= 1 << PLACE_BITS:
        return keys, np.lib.stride_tricks.sliding_window_view(keys >> np.uint64(PLACE_BITS), span).argmin(axis=1) + np.arange(n)
    # the hash's leading bits and the place in one number: its least value in a window tells the place, the first of equal ones
    low = keys >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(keys), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        low, size = np.minimum(low[: len(low) - size], low[size:]), 2 * size
    low = np.minimum(low[:n], low[span - size : span - size + n])
    return keys, (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


PLACE_BITS = 26


def _laid(words: list[list[bytes]], known: C.WordHash, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts that have any window, one text after the other, where each text begins, and all window starts.

    Texts without a window begin where the next one does, so they hold no place.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    size = np.where(n >= depth, n, 0)
    begin = size.cumsum() - size
    h = known.of([w for ws in words if len(ws) >= depth for w in ws])
    starts = np.maximum(n - depth + 1, 0)
    return h, begin, np.repeat(begin, starts) + np.arange(starts.sum()) - np.repeat(starts.cumsum() - starts, starts)


def _heads(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys and leaves equal ones as they were, and where in it each different key begins."""
    by = np.argsort(keys, kind="stable")
    return by, np.r_[True, keys[by][1:] != keys[by][:-1]]


def _anchored(n_groups: int, depth: int, labels: np.ndarray):
    """The anchors of every text: one of each batch's equal ones goes out by its hash, those that occur twice here are flagged."""

    def run(rows):
        known = C.WordHash()
        for b in C.cut(rows, 20_000, _FEW):
            ids, words = C.ids(b.column(0)), [t.split() for t in C.texts(b.column(1))]
            h, begin, start = _laid(words, known, depth)
            if not len(start):
                continue
            # windows over all words of the batch; those that cross texts are not among the starts
            runs, best = anchors(h, depth)
            used = np.unique(best[start])
            at = np.searchsorted(begin, used, "right") - 1
            keys, pos = runs[used], used - begin[at]
            by, head = _heads(keys)
            first = np.flatnonzero(head)
            several = np.repeat(np.diff(np.r_[first, len(by)]) > 1, np.diff(np.r_[first, len(by)]))
            out = {c: [] for c in SHIP}

            def add(label, sel, with_keys):
                packed = _places(at[sel], pos[sel], ids) | {"bucket": label, "n": len(sel), "keys": keys[sel].tobytes() if with_keys else None}
                for c, v in packed.items():
                    out[c].append(v)

            sent = np.sort(by[head])
            to = X.bucket(keys[sent], n_groups)
            sort = np.argsort(to, kind="stable")
            for value, lo, hi in X.slices(to[sort]):
                add(int(labels[value]), sent[sort[lo:hi]], True)
            here = np.sort(by[several])
            if len(here):
                add(int(labels[int(keys[0]) % n_groups]), here, False)
            yield X.rows_of(out, SHIP)

    return run


def _shared(labels: np.ndarray):
    """Flags for the anchors that came from two batches or more; those flagged before pass through."""

    def run(rows):
        keys, ids, pos = [], [], []
        for b in C.batches(rows):
            for _, n, k, i, c, s in zip(*(col.to_pylist() for col in b.columns)):
                docs, at = _unplace(n, i, c, s)
                if k is None:
                    yield _flags(docs, at, labels)
                else:
                    keys.append(np.frombuffer(k, np.uint64))
                    ids.append(docs)
                    pos.append(at)
        if not keys:
            return
        by, head = _heads(np.concatenate(keys))
        hit = by[~head | np.r_[~head[1:], False]]
        ids, pos = np.concatenate(ids)[hit], np.concatenate(pos)[hit]
        for lo in range(0, len(hit), 2_000_000):
            yield _flags(ids[lo : lo + 2_000_000], pos[lo : lo + 2_000_000], labels)

    return run


STRETCH = {"id": pa.int64(), "start": pa.int64(), "suffixes": pa.int64(), "text": pa.binary(), "key": pa.int64()}
STRETCH_SQL = "id long, start long, suffixes long, text binary, key long"


def _stretches(depth: int):
    """Texts with their flagged anchors: the stretches of suffixes that stay, with their words."""

    def run(rows):
        known, out, held = C.WordHash(), {k: [] for k in STRETCH}, 0
        for doc, text, flagged in _met(rows):
            if not len(flagged):
                continue
            words = text.split()
            keys, best = anchors(known.of(words), depth)
            shared = np.zeros(len(words) + 1, bool)
            shared[flagged[flagged < len(words)]] = True
            edges = np.flatnonzero(np.diff(np.r_[False, shared[best], False])).reshape(-1, 2).tolist()
            for a, b in edges:
                stretch = b" ".join(words[a : b - 1 + depth])
                for k, v in zip(STRETCH, (doc, a, b - a, stretch, int(keys[best[a:b]].min().view(np.int64)))):
                    out[k].append(v)
                held += len(stretch)
            if held > _FEW:
                yield X.rows_of(out, STRETCH)
                out, held = {k: [] for k in STRETCH}, 0
        if held:
            yield X.rows_of(out, STRETCH)

    return run


def _levels(depth: int) -> list[int]:
    return [k for k in LENGTHS if k < depth]


def _count_prefixes(depth: int, cells: int):
    def run(rows):
        known, sums = C.WordHash(), {}
        for b in C.cut(rows, 20_000, _FEW):
            h, _, start = _laid([t.split() for t in b.column(0).to_pylist()], known, depth)
            for k, length in enumerate(_levels(depth)):
                got = np.unique(X.bucket(C.windows(h, length)[start], cells), return_counts=True)
                sums[k] = got if k not in sums else _added(*sums[k], *got)
        for k, (cell, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(cell), pa.int32()), pa.array(cell, pa.int64()), pa.array(n, pa.int64())], ["level", "cell", "n"])

    return run


def _added(a, n, b, m):
    keys, of = np.unique(np.r_[a, b], return_inverse=True)
    return keys, np.bincount(of, np.r_[n, m], len(keys)).astype(np.int64)


def _whole(rows, most_bytes: int):
    """Batches joined up to a size: a dictionary is sent for each, so few and large ones are cheap."""
    held, size = [], 0
    for b in C.batches(rows):
        held.append(b)
        size += b.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _suffixes(n_groups: int, depth: int, labels: np.ndarray, cells: int, heavy: list[np.ndarray]):
    """The words of every suffix that stays, by its prefix group; of a batch's equal suffixes only the earliest."""

    def run(rows):
        known, zip_ = C.WordHash(), zstandard.ZstdCompressor(level=3)
        for b in C.cut(_whole(rows, 2 * _FEW), 1 << 20, 2 * _FEW):
            ids, starts, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist()
            order = np.lexsort((starts, ids))
            words = [texts[k].split() for k in order]
            size = np.fromiter(map(len, words), np.int64, len(words))
            flat = [w for ws in words for w in ws]
            h = known.of(flat)
            _, spot, code = np.unique(h, return_index=True, return_inverse=True)
            n = size - depth + 1
            at = np.repeat(np.arange(len(words)), n)
            inner = np.arange(len(at)) - np.repeat(n.cumsum() - n, n)
            begin = (size.cumsum() - size)[at] + inner
            pos, ids, at_id = inner + starts[order][at], ids[order], at
            # a document may have several stretches: number documents, not stretches
            names, doc = np.unique(ids, return_inverse=True)
            at_id = doc[at]
            key = C.windows(h, depth)[begin]
            by, head = _heads(key)
            lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
            rows_of = lambda sel: code[begin[sel][:, None] + np.arange(depth)]  # noqa: B023, E731
            again = np.zeros(len(key), bool)
            later = np.flatnonzero(~head)
            for lo in range(0, len(later), 200_000):  # equal hashes are compared by their words
                some = later[lo : lo + 200_000]
                again[by[some]] = (rows_of(by[some]) == rows_of(lead[some])).all(axis=1)
            group, level = key.copy(), np.full(len(key), len(heavy))
            for k in reversed(range(len(heavy))):
                prefix = C.windows(h, _levels(depth)[k])[begin]
                light = ~np.isin(X.bucket(prefix, cells), heavy[k])
                group[light], level[light] = prefix[light], k
            with np.errstate(over="ignore"):
                to = X.bucket(C.mix(group + level.astype(np.uint64) * C.BASE), n_groups)
            out = {c: [] for c in SUFFIX}

            def add(label, sel, own):
                packed = _places(at_id[sel], pos[sel], names) | {"bucket": label, "n": len(sel), "words": None, "index": None} | own
                for c, v in packed.items():
                    out[c].append(v)

            # equal rows give one suffix twice: it is neither sent again nor a repeat of itself
            itself = np.zeros(len(key), bool)
            itself[by] = ~head & (at_id[by] == at_id[lead]) & (pos[by] == pos[lead])
            sent = np.flatnonzero(~again)
            sort = np.argsort(to[sent], kind="stable")
            for value, lo, hi in X.slices(to[sent][sort]):
                sel = sent[sort[lo:hi]]
                index = rows_of(sel)
                mark = np.zeros(len(spot), bool)
                mark[index] = True
                used = np.flatnonzero(mark)
                local = np.zeros(len(spot), np.uint16 if len(used) <= 1 << 16 else np.uint32)
                local[used] = np.arange(len(used))
                index = local[index]
                add(int(labels[value]), sel, {"words": zip_.compress(b"\n".join([flat[k] for k in spot[used].tolist()])), "index": zip_.compress(index.tobytes())})
            here = np.flatnonzero(again & ~itself)
            if len(here):
                add(int(labels[int(to[0])]), here, {})
            yield X.rows_of(out, SUFFIX)

    return run


def deep_nodes(words: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (rows of word numbers) in the order of their words, ids and starts, and how many words each shares with the one before."""
    # several numbers side by side in one integer, as many as fit
    bits = max(1, int(words.max(initial=0)).bit_length())
    several, columns = 62 // bits, []
    for k in range(0, words.shape[1], several):
        column = np.zeros(len(words), np.int64)
        for j in range(k, min(k + several, words.shape[1])):
            column = column << bits | words[:, j]
        columns.append(column)
    order = np.lexsort((pos, ids, *columns[::-1]))
    equal = words[order[1:]] == words[order[:-1]]
    shared = np.where(equal.all(axis=1), words.shape[1], equal.argmin(axis=1))
    return order, np.r_[0, shared] if len(order) else shared


def _trees(labels: np.ndarray, depth: int):
    """The deep internal nodes of the groups' suffix trees: flags for all their leaves but the earliest."""

    def run(rows):
        numbers, words, ids, pos = {}, [], [], []
        unzip = zstandard.ZstdDecompressor().decompress
        for b in C.batches(rows):
            for _, n, w, index, i, c, s in zip(*(col.to_pylist() for col in b.columns)):
                docs, at = _unplace(n, i, c, s)
                if w is None:
                    yield _flags(docs, at, labels)
                    continue
                local = np.array([numbers.setdefault(x, len(numbers)) for x in unzip(w).split(b"\n")], np.int32)
                words.append(local[np.frombuffer(unzip(index), np.uint16 if len(local) <= 1 << 16 else np.uint32)].reshape(n, depth))
                ids.append(docs)
                pos.append(at)
        if not words:
            return
        numbers.clear()
        words, ids, pos = np.concatenate(words), np.concatenate(ids), np.concatenate(pos)
        order, shared = deep_nodes(words, ids, pos)
        lead = order[np.maximum.accumulate(np.where(shared < depth, np.arange(len(order)), 0))]
        hit = order[(shared >= depth) & ((ids[order] != ids[lead]) | (pos[order] != pos[lead]))]
        if len(hit):
            yield _flags(ids[hit], pos[hit], labels)

    return run


def _flags(ids: np.ndarray, pos: np.ndarray, labels: np.ndarray):
    """Rows that take repeated starts to their documents."""
    order = np.lexsort((pos, ids))
    ids, pos = ids[order], pos[order]
    part = (C.mix(ids.view(np.uint64)) % np.uint64(len(labels))).astype(np.int64)
    sort = np.argsort(part, kind="stable")
    out = {c: [] for c in MEET}
    for value, lo, hi in X.slices(part[sort]):
        sel = sort[lo:hi]
        _, at = np.unique(ids[sel], return_inverse=True)
        names = np.unique(ids[sel])
        p = _places(at, pos[sel], names)
        head = np.array([len(sel), len(names), len(p["counts"])], "<i8").tobytes()
        out["part"].append(int(labels[value]))
        out["kind"].append(0)
        out["blob"].append(head + p["ids"] + p["counts"] + p["steps"])
    return X.rows_of(out, MEET)


def _unflag(blob: bytes):
    n, docs, size = np.frombuffer(blob, "<i8", 3).tolist()
    a = 24 + 8 * docs
    return _unplace(n, blob[24:a], blob[a : a + size], blob[a + size :])


def _texts(labels: np.ndarray):
    def run(rows):
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in C.cut(rows, 20_000, 2 * _FEW):
            ids, raw = C.ids(b.column(0)), C.texts(b.column(1))
            part = (C.mix(ids.view(np.uint64)) % np.uint64(len(labels))).astype(np.int64)
            sort = np.argsort(part, kind="stable")
            out = {c: [] for c in MEET}
            for value, lo, hi in X.slices(part[sort]):
                sel = sort[lo:hi]
                head = np.array([len(sel), *ids[sel], *(len(raw[k]) for k in sel)], "<i8").tobytes()
                out["part"].append(int(labels[value]))
                out["kind"].append(1)
                out["blob"].append(zip_.compress(head + b"".join(raw[k] for k in sel)))
            yield X.rows_of(out, MEET)

    return run


def _untext(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    at = 8 + 16 * n
    for doc, size in zip(ids.tolist(), sizes.tolist()):
        yield doc, raw[at : at + size]
        at += size


def _met(rows):
    """(doc, text, flagged places) of rows by part, flags before texts."""
    part, flags, all_ids, all_pos = None, None, [], []
    for b in C.batches(rows):
        for p, kind, blob in zip(*(col.to_pylist() for col in b.columns)):
            if p != part:
                part, flags, all_ids, all_pos = p, None, [], []
            if kind == 0:
                ids, pos = _unflag(blob)
                all_ids.append(ids)
                all_pos.append(pos)
                continue
            if flags is None:
                ids = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int64)
                pos = np.concatenate(all_pos) if all_pos else ids
                sort = np.argsort(ids, kind="stable")
                pos, all_ids, all_pos = pos[sort], [], []
                flags = {v: (lo, hi) for v, lo, hi in X.slices(ids[sort])}
            for doc, text in _untext(blob):
                lo, hi = flags.get(doc, (0, 0))
                yield doc, text, pos[lo:hi]


def covered(starts: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Which of n words lie in a window of ``depth`` words at one of the starts."""
    edge = np.zeros(n + depth + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + depth, -1)
    return edge.cumsum()[:n] > 0


_out = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]


def _apply(depth: int, digest: bool):
    def run(rows):
        out, held = {k: [] for k, _ in _out}, 0
        for doc, text, starts in _met(rows):
            words = text.split()
            starts = starts[starts + depth <= len(words)]
            gone, spans = 0, []
            if len(starts):
                out_of = covered(starts, len(words), depth)
                gone = int(out_of.sum())
                edges = np.flatnonzero(np.diff(np.r_[False, out_of, False]))
                spans = [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]
                words = [w for w, x in zip(words, out_of.tolist()) if not x]
            kept = b" ".join(words)
            row = (None if doc == C.NO_ID else doc, len(words) + gone, gone, hashlib.sha256(kept).hexdigest().encode() if digest else kept, spans)
            for k, v in zip(out, row):
                out[k].append(v)
            held += len(row[3])
            if held > _FEW or len(out["doc_id"]) >= 5000:
                yield X.rows_of(out, dict(_out))
                out, held = {k: [] for k, _ in _out}, 0
        if out["doc_id"]:
            yield X.rows_of(out, dict(_out))

    return run


def _number(rows):
    """Adds the partition and the place in it to sorted rows."""
    part, at = TaskContext.get().partitionId(), 0
    for b in C.batches(rows):
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(np.arange(at, at + n))], [*b.schema.names, "part", "place"])
        at += n


def numbered(d: DataFrame) -> DataFrame:
    """(id, text_hash, number) of the distinct rows: numbers in the order of ids and text hashes, without sorting in one task."""
    spark = d.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = d.select(F.coalesce("doc_id", F.lit(C.NO_ID)).alias("id"), C.row_key("text").alias("text_hash")).distinct()
    laid = pairs.repartitionByRange(n, "id", "text_hash").sortWithinPartitions("id", "text_hash")
    laid = C.stored(laid.mapInArrow(_number, "id long, text_hash long, part int, place long"), "repeats-numbers")
    sizes = sorted((r["part"], r["count"]) for r in laid.groupBy("part").count().collect())  # a row for each range
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    starts = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    return laid.join(starts, "part").select("id", "text_hash", (F.col("start") + F.col("place")).alias("number"))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): the words left, joined by one space, and the maximal removed spans of word positions.

    With ``digest`` the kept text is replaced by its SHA-256, so that it need not leave the task.
    """
    d = C.id_text(docs, id_col, text_col)
    hashed = d.select("doc_id", C.row_key("text").alias("h"))
    numbers = None
    if hashed.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").limit(1).count():
        numbers = C.stored(numbered(d), "repeats-keys")
        keyed = d.withColumn("id", F.coalesce("doc_id", F.lit(C.NO_ID))).withColumn("text_hash", C.row_key("text"))
        d = keyed.join(numbers.hint("shuffle_hash"), ["id", "text_hash"]).select(F.col("number").alias("doc_id"), "text")
    n = X.groups(d)
    labels = X.labels(n)
    most = C.files(d, 32 << 20)  # a small table
    meet = lambda flags: flags.unionByName(d.mapInArrow(_texts(labels), MEET_SQL)).repartition(n, "part").sortWithinPartitions("part", "kind")
    flags = d.mapInArrow(_anchored(n, depth, labels), SHIP_SQL).repartition(n, "bucket").mapInArrow(_shared(labels), MEET_SQL)
    stay = C.stored(meet(flags).mapInArrow(_stretches(depth), STRETCH_SQL), "repeats-stretches", most=most)
    suffixes = stay.agg(F.sum("suffixes")).first()[0] or 0
    tasks = max(1, -(-suffixes // GROUP))
    cells = CELLS * max(512, tasks)
    counts = stay.select("text").mapInArrow(_count_prefixes(depth, cells), "level int, cell long, n long").groupBy("level", "cell").agg(F.sum("n").alias("n"))
    # at most suffixes / (GROUP / 4) cells of a level
    heavy: list[list[int]] = [[] for _ in _levels(depth)]
    for r in counts.filter(F.col("n") > GROUP // 4).select("level", "cell").collect():
        heavy[r["level"]].append(r["cell"])
    sizes = stay.groupBy("key").agg(F.ceil(F.sum("suffixes") / (GROUP // 2)).cast("int").alias("deals")).filter("deals > 1")
    salt = F.xxhash64("id", "start")
    laid = C.looked_up(stay, sizes, "key", salt, "left").withColumn("deal", F.pmod(salt, F.coalesce("deals", F.lit(1))))
    laid = laid.repartition(max(8, tasks // 2), "key", "deal").sortWithinPartitions("key", "id", "start")
    shipped = laid.select("id", "start", "suffixes", "text").mapInArrow(_suffixes(tasks, depth, X.labels(tasks), cells, [np.array(sorted(x), np.int64) for x in heavy]), SUFFIX_SQL)
    flags = shipped.repartition(tasks, "bucket").mapInArrow(_trees(labels, depth), MEET_SQL)
    got = meet(flags).mapInArrow(_apply(depth, digest), "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start:long,end:long>>")
    if numbers is not None:
        back = numbers.select(F.col("number").alias("doc_id"), F.when(F.col("id") != C.NO_ID, F.col("id")).alias("own"))
        got = got.join(back.hint("shuffle_hash"), "doc_id").select(F.col("own").alias("doc_id"), "n_words", "n_removed", "kept", "spans")
    return got.withColumn("kept", F.col("kept").cast("string"))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``documents``.

    Null text has no words; null ids stay null and come first; rows of one id are judged one by one; an empty table gives no rows.
    """
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return got.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(len(ws) - 19)) AS i, ws FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 20], ' ')) AS k FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE n > 1),
x AS (SELECT w.doc_id, unnest(ws) AS v, unnest(range(len(ws))) AS j FROM w),
k AS (SELECT x.doc_id, count(*) FILTER (c.j IS NOT NULL) AS n_removed, string_agg(x.v, ' ' ORDER BY x.j) FILTER (c.j IS NULL) AS kept
  FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
