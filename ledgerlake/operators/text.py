"""Retrieval and question tables.

Chunking is a per-row ``explode(sequence)`` + ``substring``: every document
is split in full, each row independently, so any document size works.
Nearest-vector search (X3) is in ``vectors``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.columns import r2, r6, xavg, xsum

# Routing keywords and answer phrases of the shop's question router.
METRIC_KEYWORDS = ["revenue", "orders", "customers", "average order value", "aov", "clv", "kpi",
                   "growth", "abandonment"]
TABLE_KEYWORDS = ["country", "countries", "payment method", "methods", "table"]
METRIC_RULES = [
    # (phrases, kpi metric, answer template, integer value?)
    (["total revenue"], "total_revenue", "The total revenue is %.2f.", False),
    (["average order value", "aov"], "aov", "The average order value (AOV) is %.2f.", False),
    (["total orders"], "total_orders", "The total number of orders is %d.", True),
    (["unique customers"], "unique_customers", "The number of unique customers is %d.", True),
    (["clv"], "clv", "The estimated Customer Lifetime Value (CLV) is %.2f.", False),
]
METRIC_FALLBACK = "I don't have a direct metric for that, can you be more specific?"

# The lead document of an analysis folder, in our own words.
OVERVIEW_TEXT = "The tables below describe a shop: its orders, carts, customers, products and stock, and figures drawn from them."


def n_chunks(length, size: int, overlap: int = 0):
    stride = size - overlap
    return (F.when(length.isNull() | (length == 0), F.lit(0))
             .when(length <= size, F.lit(1))
             .otherwise(F.ceil((length - F.lit(overlap)) / F.lit(stride)).cast("int")))


def chunk_text(docs: DataFrame, size: int = 500, overlap: int = 0, text: str = "text",
               keep: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """Consecutive ``size``-character chunks that overlap by
    ``overlap`` characters (stride = size - overlap); the last chunk may be
    short; empty or null text gives no chunk. Chunks inherit ``keep``."""
    stride = size - overlap
    n = n_chunks(F.length(text), size, overlap)
    exploded = docs.select(*keep, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_ix")) \
                   .where(n_chunks(F.length(text), size, overlap) > 0)
    return exploded.select(*keep, "chunk_ix", F.expr(f"substring({text}, chunk_ix * {stride} + 1, {size})")
                           .alias("chunk"))


def chunk_fixed(docs: DataFrame, size: int = 500, **kw) -> DataFrame:
    """500-character chunks."""
    return chunk_text(docs, size=size, overlap=0, **kw)


def chunk_overlap(docs: DataFrame, size: int = 2000, overlap: int = 200, **kw) -> DataFrame:
    """2000-character chunks overlapping by 200 (fixed stride of 1800)."""
    return chunk_text(docs, size=size, overlap=overlap, **kw)


SEPARATORS = ("\n\n", "\n", " ")


def chunk_separated(docs: DataFrame, size: int = 2000, overlap: int = 200, separators: Sequence[str] = SEPARATORS,
                    text: str = "text", keep: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """X2 with separators: (keep..., chunk_ix, start, chunk), ``start`` from 0.

    What is left of a text is its last chunk if it has at most ``size``
    characters. Otherwise the chunk ends after the last first-choice separator of
    its ``size`` characters, if that lies in their second half, else after the
    last second-choice one, and so on, else at ``size``. The next chunk begins
    ``overlap`` characters before that end, so the chunks cover the text. Null and
    empty texts give no chunk. A separator is one character, repeated or not.

    A fold over the chunks' numbers carries the place and the chunks so far. It
    reads the text through pages, so a step costs a page and not the text.
    """
    least = size // 2
    if overlap >= least or any(len(set(s)) != 1 for s in separators):
        raise ValueError("overlap must be below size // 2, a separator one character or its repetition")
    page = 8 * size
    length = F.length(text)
    parts = F.transform(F.sequence(F.lit(0), F.floor(length / F.lit(page)).cast("int") + 1),
                        lambda i: F.substring(F.col(text), i * page + 1, F.lit(page)))
    kind = "array<struct<start:int,chunk:string>>"

    def end_in(w):
        cut = F.lit(size)
        for s in reversed(separators):
            back = F.locate(s, F.reverse(w))
            at = F.length(w) - back + 1
            cut = F.when((back > 0) & (at >= least), at).otherwise(cut)
        return cut

    def fold(doc):
        pages, length = doc["pages"], doc["length"]  # counted once, not at every step

        def step(acc, _):
            place = acc["place"]
            # A one-element array binds a value, so that it is worked out once.
            nth = F.floor(place / F.lit(page)).cast("int")
            window = F.substring(F.concat(F.get(pages, nth), F.coalesce(F.get(pages, nth + 1), F.lit(""))), place - nth * page + 1, F.lit(size))
            moved = F.get(F.transform(F.array(window), lambda w: F.get(F.transform(
                F.array(F.when(place + size >= length, F.length(w)).otherwise(end_in(w))),
                lambda cut: F.struct(
                    F.when(place + size >= length, F.lit(-1)).otherwise(place + cut - overlap).cast("int").alias("place"),
                    F.concat(acc["done"], F.array(F.struct(place.alias("start"), F.substring(w, F.lit(1), cut).alias("chunk")))).cast(kind).alias("done"))), 0)), 0)
            return F.when(place < 0, acc).otherwise(moved)
        start = F.struct(F.lit(0).alias("place"), F.array().cast(kind).alias("done"))
        steps = F.ceil(length / F.lit(least - overlap)).cast("int") + 1
        return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["done"])

    found = docs.where(length > 0).select(*keep, F.posexplode(F.get(F.transform(F.array(F.struct(parts.alias("pages"), length.alias("length"))), fold), 0)).alias("chunk_ix", "_c"))
    return found.select(*keep, "chunk_ix", F.col("_c.start").alias("start"), F.col("_c.chunk").alias("chunk"))


def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label: (label, centroid array<double>). Work is
    per (label, dimension), so it is bounded by labels x dimensions."""
    e = vectors.where(F.col(label).isNotNull()).select(label, F.posexplode(vec).alias("pos", "x"))
    m = e.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_pm")) \
            .select(label, F.transform("_pm", lambda s: s["m"]).alias("centroid"))


def _any_contains(text_col, words: Sequence[str]):
    c = F.lit(False)
    for w in words:
        c = c | F.contains(text_col, F.lit(w))
    return F.coalesce(c, F.lit(False))


def route_questions(questions: DataFrame, text: str = "text") -> DataFrame:
    """Metric keywords first, then table keywords, else unknown."""
    low = F.lower(F.col(text))
    route = (F.when(_any_contains(low, METRIC_KEYWORDS), "metric")
              .when(_any_contains(low, TABLE_KEYWORDS), "table").otherwise("unknown"))
    table = F.when(route == "table", F.when(F.contains(low, F.lit("country")), "country")
                   .when(F.contains(low, F.lit("payment")), "payment"))
    return questions.withColumn("route", route).withColumn("table", table)


def answer_metric_questions(routed: DataFrame, kpis: DataFrame, text: str = "text") -> DataFrame:
    """For metric questions, the first matching KPI phrase answered with
    the KPI value (2 dp or integer), else the fallback sentence.

    ``kpis`` is the long (metric, value) table; each needed value enters as a
    scalar subquery, so questions are never joined to the KPI table.
    """
    low = F.lower(F.col(text))
    # Render every rule's sentence once, over the aggregated KPI row, and ship
    # all of them to the question rows in one struct-valued scalar subquery.
    vals = kpis.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
                      for _, m, _, _ in METRIC_RULES])
    rendered = vals.select(F.struct(*[
        F.format_string(tmpl, F.col(m).cast("long") if is_int else r2(m)).alias(f"r{i}")
        for i, (_, m, tmpl, is_int) in enumerate(METRIC_RULES)])).scalar()
    ans = F.lit(METRIC_FALLBACK)
    for i in range(len(METRIC_RULES) - 1, -1, -1):
        phrases = METRIC_RULES[i][0]
        sentence = rendered[f"r{i}"]
        ans = F.when(_any_contains(low, phrases) & sentence.isNotNull(), sentence).otherwise(ans)
    return routed.where(F.col("route") == "metric").withColumn("answer", ans)


def table_cell_aggregate(table: DataFrame, column: str, agg: str = "sum", where=None) -> DataFrame:
    """none/sum/average/count over the selected cells of one column
    (selection by predicate). Numeric aggregation falls back to 'none' when
    a selected cell is not numeric; 'none' answers with the selected cells
    themselves, one row each (never concatenated into one value)."""
    t = table if where is None else table.where(where)
    cell = F.col(column).cast("string")
    num = cell.try_cast("double")
    if agg == "none":
        return t.select(cell.alias("answer"))
    a = t.agg(F.count(F.lit(1)).alias("cells"), F.count_if(num.isNull()).alias("_bad"),
              xsum(num).alias("_s"), xavg(num).alias("_a"))
    val = {"sum": F.col("_s"), "average": F.col("_a"), "count": F.col("cells").cast("double")}[agg]
    ok = (F.col("_bad") == 0) | F.lit(agg == "count")
    return a.select("cells", r6(F.when(ok, val)).alias("answer_value"),
                    F.when(ok, F.lit(agg)).otherwise(F.lit("none")).alias("aggregation"))


def instruction_pairs(kpis: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """prompt/completion rows whose ``{metric}`` placeholders are filled
    from the long KPI table (values shown with 2 decimals)."""
    import re
    needed = sorted({m for _, c in templates for m in re.findall(r"\{(\w+)\}", c)})
    kv = kpis.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in needed])
    rows = []
    for prompt, completion in templates:
        comp = F.lit(completion)
        for m in sorted(set(re.findall(r"\{(\w+)\}", completion))):
            comp = F.replace(comp, F.lit("{" + m + "}"), F.format_string("%.2f", r2(F.col(m))))
        rows.append(F.struct(F.lit(prompt).alias("prompt"), comp.alias("completion")))
    return kv.select(F.explode(F.array(*rows)).alias("p")).select("p.*")
