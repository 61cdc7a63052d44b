from millrace.operators.retrieval import containing


def test_containing_equals_brute_force(spark):
    docs = [(1, "a bb ccc d"), (2, "xa bb ccc de"), (3, None), (4, ""), (5, "bb"), (6, "a  bb  ccc d"), (7, "a bb ccc d a bb ccc d"), (1, "q")]
    items = [(1, "a bb ccc d"), (2, "bb ccc"), (3, ""), (4, None), (5, "a  bb"), (6, "  "), (7, "nowhere at all")]
    got = containing(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "query_id int, text string"))
    want = {(q, d) for q, t in items for d, body in docs if t is not None and body is not None and t in body}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(set(rows))
