from pyspark.sql import functions as F

from geoweft.llm import passages, quality, similarity, simhash

from .data import documents, frame

NAMES = ("gw_text", "gw_row", "row_key", "gw_cut", "gw_fp", "gw_root", "gw_id", "gw_hash", "gw_best", "unit", "u", "v", "key", "a.b")


def test_columns_with_internal_names_stay(spark):
    docs = frame(spark, documents(20)).withColumns({n: F.lit(f"mine {n}") for n in NAMES})
    mine = " and ".join(f"`{n}` = 'mine {n}'" for n in NAMES)
    for got, more in (
        (simhash.deduplicated(docs), []), (similarity.first_of_each(docs), []), (passages.without_repeats(docs), ["gw_spans", "gw_clean"]),
        (quality.judged(docs.withColumn("gw_score", F.lit("old")), None), ["gw_score", "gw_text_score", "gw_meta_score", "gw_keep"]),
    ):
        assert sorted(got.columns) == sorted([*docs.columns, *more])
        assert got.where(mine).count() == got.count() > 0
