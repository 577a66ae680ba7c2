"""Columns named like the operators' own."""

from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, mixing, ngram_join
from ledgerlake.llm.common import fresh_prefix, prepare


def _docs(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "a"), (2, words + " more", "b"), (3, "other words of no one", "a")]
    clash = ["_n", "_i", "_s", "mix_size", "MIX_turn", "join_keep", "join_th", "leak_n_items", "leak_share", "found_n", "text_hash_"]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(77).alias(c) for c in clash])


def test_prefix_is_new():
    assert fresh_prefix(["a", "Mix_size", "mix__x"], "mix_") == "mix___" and fresh_prefix([], "t_") == "t_"


def test_clashing_columns_pass_through(spark):
    import corpus_pipeline as P

    prepare(spark)
    docs = _docs(spark)
    items = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(10)))], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.scan(docs, items).collect()}
    assert [found[i]["n_items"] for i in (1, 2, 3)] == [1, 1, 0] and found[1]["items"] == [5]
    for out in (decontaminate.scan(docs, items), mixing.mixed_documents(docs), ngram_join.keep_one_each(docs)):
        for r in out.collect():
            assert all(r[c] == 77 for c in docs.columns[3:])
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert sorted(r["doc_id"] for r in ngram_join.keep_one_each(docs).collect()) == [1, 3]
    kept = P.drop_benchmark_leaks(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and {r["leak_n_items"] for r in kept.collect()} == {77}
