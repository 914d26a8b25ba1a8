"""The inbox stream gives the batch result however files are split, and a batch may run twice."""

import json

from tessera.streaming import inbox


def test_stream_equals_batch(spark, tmp_path):
    box, state = tmp_path / "in", str(tmp_path / "state")
    box.mkdir()
    rows = [{"patch_id": f"p{k % 5}" if k % 7 else None, "annotator": f"a{k % 3}", "minute": k * 37 % 11 if k % 4 else None, "mask_source": ("untouched", "corrected", "proxy_label")[k % 3]} for k in range(40)]
    assert inbox.snapshot(spark, state).count() == 0
    for part in range(4):
        (box / f"{part}.json").write_text("\n".join(map(json.dumps, rows[part * 10 : part * 10 + 10])))
        if part == 1:
            inbox.follow(spark, str(box), state, 1).awaitTermination(120)
    inbox.follow(spark, str(box), state, 1).awaitTermination(120)
    want = inbox.newest(spark.createDataFrame([r for r in rows if r["mask_source"] != "untouched"], inbox.ENTRY))
    assert sorted(map(str, inbox.snapshot(spark, state).collect())) == sorted(map(str, want.collect()))


def test_batch_twice(spark, tmp_path):
    state, one = str(tmp_path), inbox.merge(str(tmp_path))
    a = spark.createDataFrame([("p", "x", 1, "corrected")], inbox.ENTRY)
    b = spark.createDataFrame([("p", "y", 2, "corrected"), ("q", "y", 1, "corrected")], inbox.ENTRY)
    for number, df in ((0, a), (1, b), (1, b)):
        one(df, number)
    assert sorted((r.patch_id, r.annotator) for r in inbox.snapshot(spark, state).collect()) == [("p", "y"), ("q", "y")]


def test_empty_batch(spark, tmp_path):
    inbox.merge(str(tmp_path))(spark.createDataFrame([], inbox.ENTRY), 0)
    assert inbox.snapshot(spark, str(tmp_path)).count() == 0
