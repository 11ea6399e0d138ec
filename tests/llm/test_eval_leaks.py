from inkstone.llm import eval_leaks


def test_two_texts_under_one_item_id_are_both_searched(spark):
    first, second = (" ".join(f"{c}{i}" for i in range(14)) for c in "ab")
    docs = spark.createDataFrame([(1, "x " + first + " y"), (2, "x " + second), (3, "none of it")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, first), (7, second)], "item_id bigint, text string")
    got = eval_leaks.leaked_items(docs, "doc_id", "text", items, "item_id", "text")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7), (2, 7)]
