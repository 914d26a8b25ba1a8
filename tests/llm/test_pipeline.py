"""The pipeline on a small corpus: which documents each stage must keep, and that sequences hold what is left."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    item = " ".join(f"item{chr(97 + k)}" for k in range(24))
    item = "".join(c if not c.isdigit() else "q" for c in item)
    base = [f"plain{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    rows = [(k, " ".join(base[(7 * k + j * (k + 3)) % 80] for j in range(40)), "en") for k in range(10)]
    rows += [(50, " ".join(base), "en"), (51, " ".join([*base[:-1], "other"]), "en"), (52, " ".join(base).upper(), None)]
    rows += [(60, f"see {item} there", "en"), (70, None, "en"), (71, "123 456", "en"), (80, "mail me at some.one@host.example please", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    want = set(r[0] for r in rows)
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:4], ({70, 71}, {51, 52}, {60}, set())):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        want -= gone
        assert sorted(r.doc_id for r in docs.collect()) == sorted(want), name
    text = {r.doc_id: r.text for r in docs.collect()}
    assert text[80] == "mail me at [EMAIL] please" and text[50] == rows[10][1]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def stored(spark, at, rows, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept_row string, found_row string, bad_id string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d") for i, t in rows], schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    stored(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Null ids with different texts both stay, equal rows stay once, uneven lengths and extra columns do no harm."""
    word = lambda k: "".join(chr(97 + (k * 7 + j) % 26) for j in range(3 + k % 5))
    prose = lambda seed, n: " ".join(word(seed * 13 + j * (seed + 3)) for j in range(n))
    rows = [(None, prose(1, 40)), (None, prose(2, 40)), (3, prose(3, 30)), (3, prose(3, 30)), (4, prose(4, 9000)), (None, None), (6, ""), (7, prose(1, 40))]
    stored(spark, tmp_path, rows, [(None, "nothing like it in any text at all here"), (2, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(0, prose(1, 40)), (0, prose(2, 40)), (3, prose(3, 30)), (4, prose(4, 9000))])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id or 0 for r in out}) == [0, 3, 4]
