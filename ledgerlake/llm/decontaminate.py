"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts are lower-cased words of letters and digits, and sets of their 5-word
shingles. Items are partitioned by the size of their set (powers of two). Each
partition has a sketch size K: an item's sketch is its K least shingle hashes
(bottom-K MinHash). At 80 % containment at most a fifth of an item's shingles
are missing, so with K above a fifth of the partition's largest size a
contaminated document holds at least K - floor(size / 5) of the sketch, however
long it is: the search loses nothing. Documents' shingles meet the sketches;
only documents with enough hits are cut into shingles again and verified by the
exact share of the item's shingles. Built-in DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import broadcast_if_small, fresh_prefix, written

SHINGLE, PERCENT = 5, 80
SMALL = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Distinct hashes of the 5-word shingles; a shorter text is one shingle.

    The words are bound to a lambda variable, so they are split once a text and
    not once a shingle.
    """
    def of(ws: Column) -> Column:
        n = F.size(ws)
        many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(SHINGLE)]))
        return F.array_distinct(F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>")))

    return F.get(F.transform(F.array(words), of), 0)


def missing(size: Column) -> Column:
    """Shingles that an item may lack at the least containment."""
    return F.floor(size * (100 - PERCENT) / 100).cast("int")


def item_sketches(items: DataFrame) -> DataFrame:
    """item_id, size, part, need, sketch (least hashes) and all of each item with words."""
    s = items.select("item_id", F.array_sort(shingles(words_of(F.col("text")))).alias("all")).withColumn("size", F.size("all")).where("size > 0")
    s = s.withColumn("part", F.floor(F.log2("size")).cast("int"))
    largest = (F.pow(F.lit(2.0), F.col("part") + 1) - 1).cast("int")
    k = F.least(F.col("size"), missing(largest) + 1)
    return s.withColumn("need", F.greatest(k - missing(F.col("size")), F.lit(1))).withColumn("sketch", F.slice("all", F.lit(1), k))


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(text_hash, item_id, share) for each distinct text and each item of which the text
    holds at least 80 % of the shingles. Copies of a text are searched once per
    partition of the scan and counted once."""
    index = item_sketches(items)
    keyed = docs.select(F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    sketch = broadcast_if_small(index.select("item_id", "need", F.explode("sketch").alias("h")), SMALL)
    hits = (keyed.select("text_hash", F.explode(shingles(words_of(F.col("text")))).alias("h")).join(sketch, "h")
                 .groupBy("text_hash", "item_id", "need").agg(F.count_distinct("h").alias("hits")))
    found = written(hits.where("hits >= need").select("text_hash", "item_id"), "leak-candidates")
    texts = broadcast_if_small(found.select("text_hash").distinct(), SMALL)
    again = keyed.join(texts, "text_hash", "left_semi").select("text_hash", F.explode(shingles(words_of(F.col("text")))).alias("h"))
    every = broadcast_if_small(index.select("item_id", "size", F.explode("all").alias("h")), SMALL)
    share = (again.join(every, "h").groupBy("text_hash", "item_id").agg(
        (F.count_distinct("h") / F.first("size")).alias("share")).where(F.col("share") * 100 >= PERCENT))
    return share.join(found, ["text_hash", "item_id"], "left_semi")


def scan(docs: DataFrame, items: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with n_items, items (ids, ascending) and share (the greatest) of the
    benchmark items that each document contains; names after ``prefix``.

    Null and empty texts contain nothing; items with null or wordless texts are
    ignored; an item of fewer than five words is found only in a document that
    is the same few words. Items with equal texts are all reported, a null
    item_id is counted but not listed. Repeated rows are judged alike; all
    columns pass through.
    """
    names = [prefix + c for c in ("n_items", "items", "share")]
    rest = [c for c in docs.columns if c not in names]
    tag = fresh_prefix(rest, "found_")
    key, n, ids, share = (tag + c for c in ("text_hash", "n", "ids", "share"))
    per = contained_items(docs, items).groupBy("text_hash").agg(
        F.count("*").alias(n), F.array_sort(F.collect_set("item_id")).alias(ids), F.max("share").alias(share))
    per = broadcast_if_small(written(per.withColumnRenamed("text_hash", key), "leaks"), SMALL)
    return docs.select(*rest).withColumn(key, F.xxhash64("text")).join(per, key, "left").select(
        *rest, F.coalesce(n, F.lit(0)).cast("long").alias(names[0]),
        F.coalesce(ids, F.array().cast(per.schema[ids].dataType)).alias(names[1]), F.coalesce(share, F.lit(0.0)).alias(names[2]))
