"""Periodic runs against all periods tried one after another."""

import hashlib
import random
import zlib

from tessera.llm import common, periodic


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        start = 0
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        for i, ok in enumerate(same):
            if not ok:
                if i - start + q >= max(6, 4 * q):
                    out.append((start, i - start + q, q))
                start = i + 1
    # a stretch has also the multiples of its smallest period
    return sorted(((s, n, q) for s, n, q in out if not any(p < q and a <= s and a + m >= s + n for a, m, p in out)), key=lambda r: (r[0], r[2]))


def brute_row(i, text):
    w = [x for x in (text or "").encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    n, h = len(w), zlib.crc32(str("" if i is None else i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    left = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, n, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(left))


def find(w):
    return periodic.runs(w, common.WordHash().of(w))


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(1500):
        w = []
        while len(w) < rng.randint(1, 120):
            piece = [b"%d" % rng.randint(0, 2) for _ in range(rng.randint(1, 9))]
            w += piece * rng.choice([1, 1, 3, 4, 5, 9])
            w = w[: len(w) - rng.randint(0, 2)] if w else w
        assert find(w) == brute_runs(w), w


def test_trees_alone_find_the_same_runs():
    # no stretch is taken out beforehand
    rng = random.Random(8)
    for _ in range(300):
        s = [rng.randint(1, 2) for _ in range(rng.randint(1, 90))]
        assert sorted(periodic.tree_runs(s), key=lambda r: (r[0], r[2])) == brute_runs(s), s


def test_fibonacci_words_and_powers():
    a, b = [1], [1, 2]
    while len(b) < 2000:
        a, b = b, b + a
    assert sorted(periodic.tree_runs(b), key=lambda r: (r[0], r[2])) == brute_runs(b)
    assert find([b"a"] * 5) == [] and find([b"a"] * 6) == [(0, 6, 1)]
    assert find([b"a", b"b"] * 4) == [(0, 8, 2)] and find(([b"a", b"b"] * 4)[:7]) == []


def test_long_texts():
    assert find([b"a"] * 200_000) == [(0, 200_000, 1)]
    block = [b"w%d" % k for k in range(10_000)]
    assert find([b"x", *block * 5, b"y"]) == [(1, 50_000, 10_000)]


def test_extensions_by_ancestors():
    s = [1, 2, 1, 1, 2, 1, 1, 2, 2, 1, 2]
    right = periodic.Extensions(*periodic.SuffixTree(s).leaves())
    import numpy as np

    for i in range(len(s)):
        for j in range(len(s)):
            if i != j:
                n = 0
                while max(i, j) + n < len(s) and s[i + n] == s[j + n]:
                    n += 1
                assert right(np.array([i]), np.array([j]))[0] == n


TEXTS = [None, "", " \t\n", "one", "a b a b a b a b", "a\x0bb\x0ca  b\na b a b c", "é ü é ü é ü é ü x x x x x x", "same words here " * 30, "same words here " * 30, "no run in here at all", "x " * 3000, "q" * 4000]


def test_query_rows(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 4)] + [(None, TEXTS[7]), (3, "one"), (3, "one"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_runs int, start string")
    got = [tuple(r) for r in periodic.periodic_runs(docs, periodic.rewritten).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(i, t) for i, t in rows), key=repr)
    assert periodic.periodic_runs(docs.filter("false"), periodic.rewritten).collect() == []


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c"), (2, None), (3, "left  as it was")], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.text) for r in periodic.collapse(docs).collect()}
    assert got == {1: ([(0, 8, 2)], "a b c"), 2: ([], None), 3: ([], "left  as it was")}
