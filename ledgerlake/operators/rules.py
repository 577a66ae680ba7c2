"""Typed validation rules as data, with quarantine.

A rule is (column, kind, bound). ``kind`` is what the value must be read as:
``text``, ``integer``, ``amount`` or ``date`` (``optional`` before it lets nulls
pass). ``bound`` is ``""``, ``">= 0"``, ``"> 0"`` or ``"<= as_of"``. A value that
cannot be read as its kind breaks the kind's rule alone; a bound is judged on
what can be read. All rules of a row are one projection.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]

# What a valid row of each of the shop's tables is.
ORDER_RULES: list[Rule] = [("id", "integer", ""), ("reference", "text", ""), ("client", "optional text", ""),
                           ("total", "amount", ">= 0"), ("payment", "optional text", ""), ("state", "text", ""),
                           ("date", "date", "<= as_of")]
CART_RULES: list[Rule] = [("id", "integer", ""), ("order_ref", "text", ""), ("client", "optional text", ""),
                          ("total", "amount", ">= 0"), ("carrier", "optional text", ""), ("date", "date", "<= as_of")]
INVENTORY_RULES: list[Rule] = [("id", "integer", ""), ("sfa", "text", ""), ("lib", "text", ""), ("ean", "text", ""),
                               ("qty", "integer", ""), ("factory_price", "amount", ">= 0"), ("retail", "amount", ">= 0"),
                               ("retail_us", "amount", ">= 0")]
LINE_RULES: list[Rule] = [("date", "date", "<= as_of"), ("ref", "text", ""), ("qty", "integer", "> 0"),
                          ("unit_price", "amount", ">= 0"), ("amount", "amount", ">= 0")]
MEANING = {">= 0": "must not be negative", "> 0": "must be positive", "<= as_of": "must not be in the future"}


def _read(column: str, kind: str) -> Column:
    """The value as ``kind``, null where it cannot be."""
    raw = F.col(column).cast("string")
    if kind == "date":
        return raw.try_cast("timestamp_ntz")
    if kind == "text":
        return raw
    n = raw.try_cast("decimal(38,6)")
    return F.when(n == F.floor(n), n) if kind == "integer" else n


def broken(rules: Sequence[Rule], as_of: str | None = None) -> list[tuple[str, Column]]:
    """(message, true where the rule is broken) of every rule, in order."""
    out = []
    for column, kind, bound in rules:
        optional, kind = kind.startswith("optional "), kind.removeprefix("optional ")
        value = _read(column, kind)
        missing = F.lit(False) if optional else F.col(column).isNull()
        out.append((f"{column} must be {'an' if kind in ('integer', 'amount') else 'a'} {kind}", missing | (F.col(column).isNotNull() & value.isNull())))
        if bound:
            limit = F.lit(as_of).cast("timestamp_ntz") if bound == "<= as_of" else F.lit(0)
            holds = {">= 0": value >= limit, "> 0": value > limit, "<= as_of": value <= limit}[bound]
            out.append((f"{column} {MEANING[bound]}", ~F.coalesce(holds, F.lit(True))))
    return out


def errors(rules: Sequence[Rule], as_of: str | None = None) -> Column:
    """The messages of a row's broken rules, an array."""
    return F.array_compact(F.array(*[F.when(b, F.lit(m)) for m, b in broken(rules, as_of)]))


def validate(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], as_of: str | None = None) -> DataFrame:
    """Keys, ``ok`` and the messages joined by '; ', for every row."""
    return df.select(*keys, errors(rules, as_of).alias("_e")).select(*keys, (F.size("_e") == 0).alias("ok"), F.concat_ws("; ", "_e").alias("errors"))


def quarantine(df: DataFrame, rules: Sequence[Rule], as_of: str | None = None, name: str = "errors") -> tuple[DataFrame, DataFrame]:
    """The good rows as they are, and the others with their messages in ``name``."""
    e = errors(rules, as_of)
    return df.where(F.size(e) == 0), df.withColumn(name, F.concat_ws("; ", e)).where(F.size(e) > 0)


def rule_report(df: DataFrame, rules: Sequence[Rule], as_of: str | None = None) -> DataFrame:
    """Rows read and rows that break each rule, one scan: (rule, n_rows, n_broken)."""
    found = broken(rules, as_of)
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(b).alias(f"b{i}") for i, (_, b) in enumerate(found)])
    return a.select("n", F.inline(F.array(*[F.struct(F.lit(m).alias("rule"), F.col(f"b{i}").alias("n_broken")) for i, (m, _) in enumerate(found)]))) \
            .select("rule", F.col("n").alias("n_rows"), "n_broken")
