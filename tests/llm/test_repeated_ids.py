"""Rows that share an id."""

from attesta.llm.near_dedup import keep_first


def test_different_texts_of_one_id_stay(spark):
    one, two = " ".join(f"one{i}" for i in range(40)), " ".join(f"two{i}" for i in range(40))
    docs = spark.createDataFrame([(1, one), (1, two), (1, one.upper()), (2, two + " end"), (3, None), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"] or "") for r in keep_first(docs).collect())
    assert [g for g in got if g[0] != 2] == [(1, one.upper()), (1, two), (3, "")]


def test_an_id_with_two_texts_links_their_groups(spark):
    from attesta.llm.near_dedup import near_duplicates

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (2, a), (3, b), (4, b), (2, b), (9, b), (8, c), (7, c)]
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 2), (2, 2), (3, 2), (4, 2), (9, 2), (8, 7), (7, 7)}
