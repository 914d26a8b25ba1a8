from tessera.llm import decontam


def test_items_without_an_id_are_found(spark):
    bench = spark.createDataFrame([(None, "some null item of many words"), (None, "quite another item that has no id"), (1, "an item that has an id of its own")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x some null item of many words y"), (2, "quite another item that has no id"), (3, "an item that has an id of its own"), (4, "none of these is in here at all")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(1, None), (2, None), (3, 1)}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [4]
