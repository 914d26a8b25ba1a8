import math
import zlib
from collections import Counter

from tessera.llm import classlm


def brute(rows):
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts = Counter(w for i, t in rows for w in words(t) if fold(i) != 2)
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, fold(i) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out, key=repr)


def test_counts_against_brute_force(spark):
    rows = [(k, f"the Word{k % 3} of  THE day\n{k % 5} é{k}") for k in range(40)]
    rows += [(3, rows[3][1]), (100, None), (101, ""), (None, "the odd one"), (102, "the " * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    got = classlm.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == brute(rows)
    assert all(r.score <= 0 and r.perplexity >= 1 for r in got)


def test_model_is_a_distribution():
    import numpy as np

    rng = np.random.default_rng(1)
    n = rng.integers(0, 20, (12, 12)).astype(np.int64)
    n[10, 10] = 0
    of = classlm.cluster(n, classes=3)
    assert of[-2:].tolist() == [3, 4] and of[:-2].max() <= 2
    m = classlm.Model(list(range(10)), np.r_[n.sum(axis=0)[:10], n.sum(axis=0)[11]].astype(float), n, int(n.sum()), 30)
    assert np.allclose((10**m.after).sum(axis=1), 1, atol=1e-9)
    for c in range(m.of.max() - 1):
        assert (10 ** m.emit[:-2][m.of[:-2] == c]).sum() < 1


def test_empty(spark):
    assert classlm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_training_word_has_a_class(spark):
    import numpy as np

    # more words than are clustered as frequent ones; rare x stand where an a does, rare y where a b does
    word = lambda k, j: f"{'xy'[j % 2]}{k}q{j}" if j % 5 == 4 else f"{'ab'[j % 2]}{(k * 7 + j * j) % 10}"
    rows = [(k, " ".join(word(k, j) for j in range(60))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = classlm.fit(docs)
    train = {w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.encode().split()}
    k = len(fitted["model"].classes)
    of, placed = dict(zip(fitted["model"].keys, fitted["model"].of.tolist())), {}
    for r in fitted["table"].collect():
        placed.update(zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["classes"], np.uint16).tolist()))
    of.update(placed)
    key = {w: classlm.xxhash.xxh3_64_intdigest(w) for w in train}
    assert len(train) > 600 and set(of) == set(key.values()) and max(of.values()) < k - 2
    # what a rare word stands between decides its class
    kinds = [{of[key[w]] for w in train if w[:1] == c and key[w] in placed} for c in (b"x", b"y")]
    assert kinds[0] and kinds[1] and not kinds[0] & kinds[1]
    assert classlm.n_classes(10**6) > classlm.n_classes(10**5) > classlm.n_classes(10)


def test_placing_by_the_gain_of_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(3)
    g = rng.integers(0, 30, (6, 6))
    total = lambda m: classlm._xlogx(m).sum() - classlm._xlogx(m.sum(axis=0)).sum() - classlm._xlogx(m.sum(axis=1)).sum()
    for _ in range(20):
        q, r = np.zeros(6), np.zeros(6)
        np.add.at(q, rng.integers(0, 6, 12), 1)
        np.add.at(r, rng.integers(0, 6, 12), 1)
        gains, whole = [], g.astype(float)
        whole[4] += r  # class 4 holds the word before it is placed
        whole[:, 4] += q
        for c in range(4):
            m = whole.copy()
            m[4] -= r
            m[:, 4] -= q
            m[c] += r
            m[:, c] += q
            gains.append(total(m))
        both = np.r_[q, r].astype(int)
        at = np.flatnonzero(both)
        assert classlm.Placing(whole).of(np.array([0]), at, both[at])[0] == int(np.argmax(gains))


def test_scores_against_plain_loops(spark):
    """Every text's score from the words' classes alone: transition and emission probabilities counted by hand."""
    import random

    import numpy as np
    import xxhash

    rng = random.Random(4)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(words[min(119, int(rng.expovariate(0.06)))] for _ in range(rng.randint(0, 60)))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in classlm.score(docs).collect()}
    fitted = classlm.fit(docs)
    frequent, of = fitted["frequent"].value
    model, k = fitted["model"], len(fitted["model"].classes)
    table = {}
    for r in fitted["table"].collect():
        table |= dict(zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["classes"], np.uint16).tolist()))

    def cls(word):
        key = xxhash.xxh3_64_intdigest(word.encode())
        if word == "":
            return k - 1
        at = int(frequent.of(np.array([key], np.uint64))[0])
        return int(of[at]) if at < frequent.size else table.get(key, k - 2)

    fold = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    texts = {i: [*t.split(), ""] for i, t in rows}
    count, after = Counter(), Counter()
    for i, ws in texts.items():
        if fold(i):
            count.update(ws)
            cs = [cls(w) for w in ws]
            after.update(zip([k - 1, *cs[:-1]], cs))
    into, out, total = Counter(), Counter(), sum(after.values())
    for (a, b), n in after.items():
        out[a] += n
        into[b] += n
    mass, size = Counter(), Counter()
    for w, n in count.items():
        mass[cls(w)] += n
        size[cls(w)] += 1

    def step(a, b):
        share = (into[b] + 1) / (total + k)
        return math.log10((after[a, b] + classlm.INTERPOLATE * share) / (out[a] + classlm.INTERPOLATE))

    def emit(w):
        c = cls(w)
        if w == "":
            return 0.0  # the end is its whole class
        return math.log10((count[w] + 1) / (mass[c] + size[c] + 1))

    for i, ws in texts.items():
        cs = [cls(w) for w in ws]
        want = sum(step(a, b) + emit(w) for a, b, w in zip([k - 1, *cs[:-1]], cs, ws))
        assert math.isclose(got[i], want, rel_tol=1e-6, abs_tol=1e-6), i
    assert model.n_words == len(count)
