"""Mixing sources to target weights by a low-discrepancy schedule.

Words are dealt in blocks of ``BLOCK`` words. Each source's documents are laid
end to end in shuffled order (by hash) and cut into equal blocks. Slot k of the
schedule has the point frac(k * golden ratio), taken in exact integers; mapped
through the cumulative weights of the sources it names the slot's source, and
the slot's rank among that source's slots names its block (round after round).
Slots join blocks; a document's taken words are those of its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import NON_WORD, broadcast_if_small, fresh_prefix, prefix_sums, word_count, written

WEIGHTS = (3, 1, 2)
SHARE, CAP, BLOCK, SEED = 1.5, 2, 256, 17
#: Golden ratio's fraction times 2**40, made odd: points run through [0, 2**40).
GOLDEN = 679_532_859_829 | 1
_BITS = 40
_CELL_BITS = 28
SMALL = 100_000
RESULTS = ("size", "source_size", "target", "taken")


def point(k) -> F.Column:
    """k * GOLDEN mod 2**40 without overflow, for 0 <= k."""
    low, high = k.bitwiseAND((1 << 20) - 1), F.shiftright(k, 20).bitwiseAND((1 << 20) - 1)
    upper = F.shiftleft((high * F.lit(GOLDEN)).bitwiseAND((1 << 20) - 1), 20)
    return (upper + low * F.lit(GOLDEN)).bitwiseAND((1 << _BITS) - 1)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """One row per source: sid, source, source_size, target, goal (target in whole
    words), blocks, slots, lo and hi (its part of [0, 2**40)).

    Sources stand by code point, null last; weights repeat along them. The level
    L with sum(min(cap * size, weight * L)) = share * all sizes is found from
    running sums over the sources by cap * size / weight. The windows here run
    over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    s = s.withColumn("sid", F.row_number().over(by_name).cast("int"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", (F.col("source_size") * cap).cast("double"))
    every = Window.partitionBy()
    up = Window.orderBy(F.col("most") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(share)
    s = s.withColumn("level", (total - F.coalesce(F.sum("most").over(up), F.lit(0.0)))
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0))))
    s = s.withColumn("free", F.col("most") > F.col("w") * F.col("level"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("w"), "sid", "level"))).over(every)
    s = s.withColumn("target", F.least("most", F.coalesce(F.col("w") * first["level"], F.col("most"))))
    size = F.greatest("source_size", F.lit(1))
    s = s.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("slots", (F.floor(F.col("goal") / size) * F.col("blocks") + F.ceil((F.col("goal") % size) / block)).cast("long"))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.sum("slots").over(upto) / F.greatest(F.sum("slots").over(every), F.lit(1))
    s = s.withColumn("hi", F.floor(edge * F.lit(float(1 << _BITS))).cast("long"))
    return s.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0)).cast("long")).select(
        "sid", "source", "source_size", "docs", "target", "goal", "blocks", "slots", "lo", "hi")


def schedule(sources: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """slot, sid, rank, epoch, block, words: the blocks in the order in which the mix
    takes them. ``total`` is the sum of the sources' slots. A source that the points
    served less often than its slots gets the rest at the end."""
    spark = sources.sparkSession
    parts = sources.where("hi > lo").select("sid", "slots", "lo", "hi", F.explode(F.sequence(
        F.shiftright("lo", _CELL_BITS), F.shiftright(F.col("hi") - 1, _CELL_BITS))).alias("cell"))
    slots = spark.range(total).withColumn("u", point(F.col("id"))).withColumn("cell", F.shiftright("u", _CELL_BITS))
    named = slots.join(parts, "cell").where("u >= lo AND u < hi").select(
        F.col("id").alias("slot"), "sid", F.floor(F.col("id") * F.lit(float(1 << _BITS)) / F.lit(max(total, 1))).cast("long").alias("_rank"),
        F.lit(1).cast("long").alias("one"))
    ranked = prefix_sums(named, ["sid"], [F.col("slot")], "one", total).select("slot", "sid", F.col("_before").alias("rank"))
    got = ranked.groupBy("sid").agg(F.count("*").alias("got"))
    rest = sources.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots").select(
        "sid", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    every = ranked.unionByName(rest.withColumn("slot", F.lit(total) + F.col("rank")))
    out = every.join(broadcast_if_small(sources, SMALL), "sid").where("rank < slots")
    out = out.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")).cast("long")).withColumn("block", F.col("rank") % F.col("blocks"))
    at = F.col("block") * block
    return out.select("slot", "sid", "rank", "epoch", "block", F.least(
        F.lit(block).cast("long"), F.col("source_size") - at, F.col("goal") - F.col("epoch") * F.col("source_size") - at).alias("words"))


def mix(docs: DataFrame, keep: list[str], weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK,
        seed: int = SEED, prefix: str = "") -> DataFrame:
    """``keep`` columns of every document with size, source_size, target and taken
    (their names after ``prefix``).

    ``docs`` has doc_id, text and source. A null text has size 0 and is never
    taken; a null source is a source of its own, the last; repeated rows are
    documents of their own; null ids are allowed. No document is taken more than
    ``cap`` times its size, and a source's taken words are its target, rounded.
    Only ids, sizes and sources are shuffled besides ``keep``.
    """
    kept = [f"_k{i}" for i in range(len(keep))]  # no clash with the names used here
    sized = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col("doc_id").alias("_id"),
                        F.col("source").alias("source"), word_count(F.col("text")).alias("size"))
    sources = written(source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, cap, block), "sources")
    n, total = sources.agg(F.sum("docs"), F.sum("slots")).first()
    n, total = n or 0, total or 0
    small = broadcast_if_small(sources.select("sid", F.col("source").alias("_s"), "source_size", "target"), SMALL)
    rows = sized.join(small, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    rows = rows.withColumn("_rank", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "sid", "_id", "size"), 64 - _BITS))
    laid = prefix_sums(rows, ["sid"], [F.col("_id"), F.col("size")], "size", n)
    key = ["sid", "_cell", "_pos"]
    last = F.col("_before") + F.col("size") - 1
    pieces = laid.select(*key, "size", "_before", F.explode(F.when(F.col("size") > 0, F.sequence(
        F.floor(F.col("_before") / block), F.floor(last / block))).otherwise(F.array(F.lit(-1).cast("long")))).alias("block"))
    off = F.greatest(F.col("_before") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("_before") + F.col("size") - F.col("block") * block, F.lit(block))
    taken = pieces.withColumn("off", off).withColumn("len", end - off).join(
        schedule(sources, total, block).select("sid", "block", "words"), ["sid", "block"], "left")
    part = F.greatest(F.lit(0), F.least(F.coalesce("words", F.lit(0)) - F.col("off"), F.col("len")))
    sums = taken.groupBy(*key).agg(F.sum(part).cast("long").alias("taken"))
    return laid.join(sums, key).select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)],
                                       *[F.col(c).alias(prefix + c) for c in RESULTS])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each time a document is taken, with the
    columns of ``docs``. At most one document of a source is taken in part; that
    row's text holds its first words joined by blanks (and n_chars, if there, its length)."""
    cols = docs.columns
    tag = fresh_prefix(cols, "mix_")
    out = mix(docs, cols, prefix=tag, **options)
    size, taken, turn = F.col(tag + "size"), F.col(tag + "taken"), F.col(tag + "turn")
    out = out.where(taken > 0).withColumn(tag + "turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((taken - 1) / size))))
    left = F.least(size, taken - turn * size)
    cut = F.array_join(F.slice(F.split(F.regexp_replace("text", "^" + NON_WORD, ""), NON_WORD), F.lit(1), left.cast("int")), " ")
    text = F.when(left < size, cut).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in cols:
        new["n_chars"] = F.when(left < size, F.char_length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in cols])
