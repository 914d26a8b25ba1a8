"""Single very long texts: many matches, long runs of one kind of character, an item repeated many times."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import classlm, decontam, langid, media, neardup, ngramjoin, packing, periodic, pii, secrets, spelling, substring


def table(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_many_addresses_in_a_text(spark):
    text = "a@b.cc " * 100_000
    rows = {r.doc_id: r for r in pii.find(table(spark, [text, "x +1 23456789 y"])).collect()}
    assert [(s.start, s.end) for s in rows[0].spans] == [(7 * k, 7 * k + 6) for k in range(100_000)]
    assert [(s.start, s.kind, s.end) for s in rows[1].base] == [(2, 3, 13)]
    got = {r.doc_id: r.text for r in pii.redact(table(spark, [text])).collect()}
    assert got[0] == "[EMAIL] " * 100_000


def test_many_tokens_and_spans_of_several_words(spark):
    # spans that start and end in different tokens, tokens between them
    text = " ".join(f"call +44 20 {k % 9000 + 1000} 77{k % 90 + 10} now id{k} mail u{k}@h.org" for k in range(4000))
    base = [(m.start(), m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text)]
    got = pii.find(table(spark, [text])).first()
    assert [(s.start, s.end) for s in got.base if s.kind == 3] == base and sum(s.kind == 0 for s in got.base) == 4000


def test_spans_meet_the_tokens_around_them(spark):
    text = "my no +44 20 7946 0958 is old, mail joe@x.org or ab1x today 12.13.14.15"
    scanned = pii._scan(table(spark, [text]).select("doc_id", "text"))
    got = {(r.pattern, r.instance, r.seed) for r in pii._candidates(scanned).collect()}
    want = {("my no _", "+44 20 7946 0958", True), ("_ is old,", "+44 20 7946 0958", True), ("old, mail _", "joe@x.org", True), ("_ or ab0x", "joe@x.org", True), ("mail _ or", "joe@x.org", True)}
    want |= {("joe@x.org or _", "ab1x", False), ("_ today 00.00.00.00", "ab1x", False), ("or _ today", "ab1x", False), ("ab0x today _", "12.13.14.15", True)}
    assert got == want


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "a" * 300_000, "1" * 300_000, "\n" * 500_000, "é" * 200_000])
def test_packing_takes_long_runs_of_one_character(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids) + 1
    got = packing.pack(table(spark, [text])).agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).first()
    assert (got.n, got.pieces) == (want, -(-want // 1024))


def test_an_item_repeated_in_a_text(spark):
    item = " ".join(f"word{k}" for k in range(20))
    long = " ".join(f"term{k}" for k in range(300))
    bench = spark.createDataFrame([(1, item), (2, "not in any of the texts at all")] + [(3, long)], "item_id long, text string")
    docs = table(spark, ["x " + f"{item} " * 10_000, "y z " + f"{long} " * 300, "clean text of a few words"])
    got = sorted((r.doc_id, r.item_id, r.window_start, r.similarity) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(0, 1, 1, 1.0), (1, 3, 2, 1.0)]
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [2]


RUNS = [c * 100_000 for c in ("a", " ", "1", "-", "+1", "@.", "a@", "é", "\n", "a ", "A1 ", "=", "_x9")]


@pytest.mark.parametrize("name", ["media", "secrets", "substring", "neardup", "ngramjoin", "periodic", "spelling", "classlm", "langid"])
def test_long_runs_of_each_kind(spark, name, tmp_path):
    docs = table(spark, RUNS)
    run = {
        "media": lambda: media.fingerprint_wav(media.store_wav(docs)),
        "secrets": lambda: secrets.scan_incremental(docs.withColumnRenamed("doc_id", "path"), str(tmp_path / "ledger")),
        "substring": lambda: substring.remove_repeats(docs),
        "neardup": lambda: neardup.near_duplicates(docs),
        "ngramjoin": lambda: ngramjoin.ngram_join(docs),
        "periodic": lambda: periodic.periodic_runs(docs, periodic.rewritten),
        "spelling": lambda: spelling.spelling_variants(docs).groupBy().count(),
        "classlm": lambda: classlm.score(docs),
        "langid": lambda: langid.predict(docs, langid.fit(docs)),
    }[name]()
    assert run.count() == (1 if name == "spelling" else len(RUNS))
