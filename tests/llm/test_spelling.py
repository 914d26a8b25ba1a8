"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import spelling

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def made_up(seed, n):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdeéÿ×Àñ") for _ in range(rng.randint(6, 12))) for _ in range(40)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(60):
            w = bases[min(rng.randrange(40), rng.randrange(40))]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcÀ") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((k, rng.choice([" ", "1", ". ", "_"]).join(words)))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_made_up_words(spark):
    rows = made_up(1, 60) + [(None, None), (7, ""), (8, "short"), (9, "Ångström Ångström ångström"), (None, "nullable nullable nullabel"), (None, "nullable")]
    assert result(spelling.spelling_variants(table(spark, rows))) == brute(rows)


def test_upper_trees_give_the_same(spark):
    rows = made_up(2, 80)
    want = brute(rows)
    assert len(want) > 200
    for cell in (16, 64):
        assert result(spelling.spelling_variants(table(spark, rows), cell=cell)) == want


def test_chains_of_forms(spark):
    chain = [("abcdefgh", 1200), ("abcdefg", 110), ("abcdefx", 10), ("abcdefxy", 2)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    got = result(spelling.spelling_variants(table(spark, rows)))
    assert got == brute(rows)
    assert {r[0]: r[2] for r in got}.get("abcdefx", "abcdefgh") == "abcdefgh"


def test_no_rows_and_no_words(spark):
    assert result(spelling.spelling_variants(table(spark, [(1, "x")]).filter("false"))) == []
    assert result(spelling.spelling_variants(table(spark, [(1, None), (2, "a b c")]))) == []


def test_long_runs_of_letters(spark):
    long = "ab" * 3000
    rows = [(1, f"{long} {long}"), (2, f"{long}c {long}c"), (3, f"{'ab' * 2999}ba {'ab' * 2999}ba {'ab' * 2999}aa {'ab' * 2999}aa")]
    got = result(spelling.spelling_variants(table(spark, rows)))
    assert got == brute(rows) and sorted(r[4] for r in got) == [1, 1, 2, 2]


def test_tree_finds_all_within_reach():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, (500, spelling.DIMS)).astype(np.int16)
    v[:, 6:] = 0
    v[100:200] = v[0]  # equal vectors stay in one leaf
    tree = spelling.Tree(v, leaf=8)
    for radius in (0, 1, 2):
        who, leaf = tree.reach(v, radius)
        got = {(int(w), int(p)) for w, k in zip(who, leaf) for p in tree.order[tree.start[k] : tree.end[k]]}
        far = np.abs(v[:, None].astype(int) - v[None]).sum(axis=2)
        assert {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= radius))} <= got
        assert len(got) < 500 * 500
