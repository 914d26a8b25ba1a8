"""The similarity join against all pairs of sets."""

import random

import numpy as np

from tessera.llm import common, ngramjoin


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    least = lambda i: -(1 << 63) if i is None else i
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), 1 << 62), least(i))
    back = lambda i: None if i == -(1 << 63) else i
    return sorted(((i, len(sets[k]), back(low[find(k)])) for k, (i, _) in enumerate(rows)), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], "doc_id long, text string, n_shingles int, row string, part int")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def mutated(rng, words, most):
    w = list(words)
    for _ in range(rng.randint(0, most)):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


def corpus(seed, groups, size, n=90, most=4, shared=0):
    """Groups of near copies at about the border of the similarity, with a common passage in every text."""
    rng = random.Random(seed)
    passage = [f"law{k}" for k in range(shared)]
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(size):
            rows.append((len(rows), " ".join([*mutated(rng, base, most), *passage])))
    rng.shuffle(rows)
    return rows


EDGES = [(None, None), (None, "a b c d e"), (500, ""), (501, " \t\n"), (502, "One two"), (503, "one  TWO"), (504, "one two three"), (505, "a b c d e"), (506, "a b c d e"), (506, "x y z"), (507, "x y z"), (508, "É b c d"), (509, "é b c d")]


def test_groups_at_the_border(spark):
    rows = corpus(1, 25, 6) + EDGES
    want = brute(rows)
    assert result(ngramjoin.ngram_join(table(spark, rows))) == want
    assert len({r[2] for r in want}) < len(want) - 20


def test_common_passages_and_many_destinations(spark):
    rows = corpus(2, 40, 4, n=40, most=2, shared=30)
    assert result(ngramjoin.ngram_join(table(spark, rows), group_bytes=2000)) == brute(rows)


def test_a_group_of_many_chunks(spark):
    # chains of copies of copies, so that a group has several components and links between chunks
    rng = random.Random(3)
    text, rows = [f"w{k}" for k in range(60)], []
    for k in range(220):
        text = mutated(rng, text, 1) if k % 40 else [f"w{rng.randrange(70)}" for _ in range(60)]
        rows.append((k, " ".join(text)))
    for chunk in (7, 60):
        assert result(ngramjoin.ngram_join(table(spark, rows), chunk=chunk)) == brute(rows)


def test_templates_without_a_main_component(spark):
    # one template with a few fields: all similar to some degree, few enough to be linked
    rng = random.Random(4)
    rows = []
    for k in range(150):
        w = [f"t{j}" for j in range(80)]
        for at in (10, 30, 50, 70):
            w[at] = f"v{rng.randrange(6)}"
        rows.append((k, " ".join(w)))
    assert result(ngramjoin.ngram_join(table(spark, rows), chunk=20)) == brute(rows)


def test_buckets_beyond_their_size(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BUCKET", 5)
    rows = corpus(5, 4, 40)
    assert result(ngramjoin.ngram_join(table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert result(ngramjoin.ngram_join(table(spark, EDGES).filter("false"))) == []


def test_prefixes_meet_under_every_order():
    rng = np.random.default_rng(6)
    for _ in range(200):
        both = rng.integers(0, 1 << 40, 200).astype(np.uint64)
        n = int(rng.integers(5, 180))
        a = both[:n]
        b = np.concatenate([a[: n - int(rng.integers(0, 1 + n // 12))], both[180 : 180 + int(rng.integers(0, 4))]])
        if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
            continue
        scale = dict(zip(both.tolist(), rng.integers(1, 256, 200)))
        for order in range(ngramjoin.ORDERS):
            first = []
            for s in (a, b):
                by = np.lexsort(ngramjoin._ranks(s, np.array([scale[x] for x in s.tolist()], np.uint8), order))
                first.append(s[by][: int(ngramjoin.prefix(np.array([len(s)]))[0])])
            assert len(np.intersect1d(*first))


def test_scaled_counts_never_fall():
    s = ngramjoin.scaled(np.arange(1, 100_000)).astype(int)
    assert (np.diff(s) >= 0).all() and s[0] == 1 and s[1] == 2 and s[-1] <= 255


def test_sets_grow_like_all_pairs():
    rows = corpus(7, 3, 30)
    known = common.WordHash()
    sets = [ngramjoin.shingles(t.encode(), known) for _, t in rows]
    grown = ngramjoin.Sets(sets).grown()
    want = {i: c for i, _, c in brute(rows)}
    assert all((grown[a] == grown[b]) == (want[rows[a][0]] == want[rows[b][0]]) for a in range(len(rows)) for b in range(a))
