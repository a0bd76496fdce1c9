from attesta.llm import simhash as sh


def test_null_and_repeated_ids_join_no_groups(spark):
    a, b, c, d = ("a b c d e f", "one two three four five six", "k l m n o p", "red green blue black white grey")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (5, d), (None, c)]
    got = sh.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, a), (0, b), (5, c), (5, d)])
