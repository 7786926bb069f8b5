from geoweft.llm import passages, queries


def cut(spark, rows):
    return {r["doc_id"]: r["gw_clean"] for r in passages.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), short_lines=True).collect()}


def test_short_lines_go_too(spark):
    got = cut(spark, [(1, "Share this page\nfirst own text"), (2, "second own text\nshare  this page\nits end"), (3, "Share this page")])
    assert got == {1: "Share this page\nfirst own text", 2: "second own text\n\nits end", 3: ""}


def test_short_lines_of_several_sentences(spark):
    got = cut(spark, [(1, "Stop. Go on.\nmore of one"), (2, "Its start\nStop. Go on.\nmore of two"), (3, "Go on. Something else stands here.")])
    assert got[1] == "Stop. Go on.\nmore of one" and got[2] == "Its start\n\nmore of two"
    assert got[3] == "Go on. Something else stands here."


def test_lines_within_one_text_and_beside_sentences(spark):
    got = cut(spark, [(1, "Menu\nMenu\nOne more. Yes."), (2, "Own words here. One more.\nMenu\nYes. And no other.")])
    assert got[1] == "Menu\n\nOne more. Yes." and got[2] == "Own words here. One more.\n\nYes. And no other."


def test_query_removes_short_lines(spark, tmp_path):
    spark.createDataFrame([(1, "Share this page"), (2, "Share this page\nown text")], "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert [(r["doc_id"], r["start"], r["stop"], r["kept_doc_id"]) for r in queries.op8_passages(spark, f"file://{tmp_path}").collect()] == [(2, 0, 15, 1)]
