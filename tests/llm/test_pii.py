import hashlib
import re

from tessera.llm import pii

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(RULES):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


CASES = [
    None, "", "plain words", "a@b.c", "x.y+z@host.example.org, a@b.co_c@d.com @ a@@b.c q@w", "a@b.c.d..e f@g.-h",
    "1.2.3.4 256.1.1.1 001.02.3.255 1.2.3 1.2.3.4.5.6.7.8 9.9.9.9.", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 0000 00000000",
    "call +1 (555) 123-4567 or +44.20.7946.0958. +1 2 +12345678 +1234567890123456", "é😀 a@b.cd 😀 10.0.0.1\tx +49 30 1234567",
    "1" * 3000, "a." * 2000 + "@x.y", "1 " * 2000, "+" * 50 + "1 " * 300, "9.9." * 1500,
]


def test_base_spans_against_brute_force(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(CASES)] + [(3, CASES[3], 1), (None, "z@y.x", 1)], "doc_id long, text string, base int")
    got = {r.doc_id: r for r in pii.find(docs).withColumn("d", pii.digest("base")).collect()}
    for k, t in enumerate(CASES):
        assert got[k].d.split(",") if got[k].d else [] == brute(t or ""), k
        assert (got[k].d or "") == ",".join(brute(t or "")), (k, t)
    assert got[None].d == "email:0:5"


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: ",".join(brute(r.text)) for r in docs.collect()}
    got = {r.doc_id: r for r in pii.op6_pii(spark, "/root/testdata/sf0.001").collect()}
    assert {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()} == {k: r.base_sha256 for k, r in got.items()}


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(k, f"Some talk {k}. Patient reachable under u{k}@mail{k}.example and more of it {k}") for k in range(12)]
    rows += [(50, "Patient reachable under XK-99-4711-B, she said"), (51, "Other words before XK-99-4711-C here")]
    got = {r.doc_id: r.spans for r in pii.op6_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "context:24:36" and got[51] == ""
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50] == "Patient reachable under [CONTEXT], she said" and out[51] == rows[-1][1] and "[EMAIL]" in out[3] and "@" not in out[3]


def _context(spark, seed_rows, rows):
    docs = spark.createDataFrame([*enumerate(seed_rows), *((1000 + k, t) for k, t in enumerate(rows))], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.op6_text(docs).collect()}
    return [[x for x in got[1000 + k].split(",") if x.startswith("context")] for k in range(len(rows))]


def test_contexts_hold_digits_and_long_words(spark):
    long = "reachable" * 12
    seeds = [f"Some patient {k} under u{k}@mail{k}.example and {long} by v{k}@mail.example too" for k in range(12)]
    assert _context(spark, seeds, ["patient 7 under XK-99-4711-B", f"all {long} by XK-99-4712-B", f"all x{long} by XK-99-4713-B"]) == [["context:16:28"], [f"context:{8 + len(long)}:{20 + len(long)}"], []]


def test_lists_of_identifiers(spark):
    seeds = [f"ids known as u{k}@mail.example 4417{k:02d}9 end" for k in range(12)]
    got = _context(spark, seeds, ["ids known as XK-99-4711-B XK-99-4712-B"])
    assert got[0][:1] == ["context:13:25"]


def test_whole_phones_and_cards_are_seeds(spark):
    phones = [f"Please call me on +1 (743) 555-{3800 + k} soon" for k in range(9)]
    numbers = [f"4111 1111 1111 {k}" for k in range(1000, 1100) if luhn(f"411111111111{k}")]
    cards = [f"They paid with card {c} and rest" for c in numbers]
    assert _context(spark, phones + cards, ["Please call me on 7435553824 soon", "They paid with card AB-1234-5678 now"]) == [["context:18:28"], ["context:20:32"]]


def test_patterns_are_scored_by_their_support(spark):
    seeds = [f"we are reachable under u{k}@mail.example" for k in range(12)]
    unknown = [f"we are reachable under XK-99-47{k}-B" for k in range(10, 18)]
    assert all(_context(spark, seeds, unknown))
    few = [f"we are reachable under u{k}@mail.example" for k in range(3)]
    assert not any(_context(spark, few, unknown))


def test_contexts_on_the_right_and_around(spark):
    right = [f"Write u{k}@mail.example for a refund, number {k}" for k in range(12)]
    around = [f"The {'abcdefghijkl'[k]} of account u{k}@bank.example belongs {'mnopqrstuvwx'[k]} now" for k in range(12)]
    got = _context(spark, right + around, ["XK-99-4711-B for a treat", "my account XK-99-4712-B belongs here", "XK-99-4713-B for the treat", "account XK-99-4714-B was"])
    assert got == [["context:0:12"], ["context:11:23"], [], []]


def test_long_identifiers_and_many_matches(spark):
    long = "XK-" + "99-4711-" * 9 + "B"
    seeds = [f"we are reachable under u{k}@mail.example" for k in range(12)]
    assert _context(spark, seeds, [f"reachable under {long}"]) == [[f"context:16:{16 + len(long)}"]]
    text = "😀 " + " ".join(f"u{k}@mail.example, 10.0.{k % 256}.7" for k in range(700))
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumn("d", pii.digest("base")).first()
    assert row.d.split(",") == brute(text)
    out = pii.redact(spark.createDataFrame([(1, text), (2, text[:300]), (2, None)], "doc_id long, text string")).collect()
    want = "😀 " + " ".join(["[EMAIL], [IP]"] * 700)
    assert sorted((r.doc_id, (r.text or "")[:11]) for r in out) == [(1, want[:11]), (2, ""), (2, want[:11])] and {r.text for r in out if r.doc_id == 1} == {want}


def test_running_sums_across_blocks(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK + 7):
        values = [(7 * k) % 11 for k in range(n)]
        df = spark.createDataFrame([(values,)], "a array<int>")
        got = df.select(pii.running(F.col("a"), lambda x, y: x + y).alias("s"), pii.running(F.col("a"), F.greatest).alias("m")).first()
        assert got.s == [sum(values[: k + 1]) for k in range(n)] and got.m == [max(values[: k + 1]) for k in range(n)]
