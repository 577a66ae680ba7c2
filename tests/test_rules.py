"""Every rule fails at least once, and quarantine splits the rows."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import rules as R

GOOD = {"integer": "12", "text": "a", "amount": "3.50", "date": "2023-05-01 10:00:00"}
TABLES = {"orders": R.ORDER_RULES, "carts": R.CART_RULES, "inventory": R.INVENTORY_RULES, "lines": R.LINE_RULES}


@pytest.mark.parametrize("name", TABLES)
def test_each_rule_is_broken_alone(spark, name):
    rules = TABLES[name]
    good = {c: GOOD[k.removeprefix("optional ")] for c, k, _ in rules}
    rows, want = [("good", good)], {"good": ""}
    for c, kind, bound in rules:
        bare = kind.removeprefix("optional ")
        noun = f"{c} must be {'an' if bare in ('integer', 'amount') else 'a'} {bare}"
        rows.append((f"{c} null", good | {c: None}))
        want[f"{c} null"] = "" if kind.startswith("optional") else noun
        for bad in {"integer": ["1.5", "x", "NaN"], "amount": ["12 EUR", "", "NaN"], "date": ["2023-13-01", "soon"], "text": []}[bare]:
            rows.append((f"{c} {bad!r}", good | {c: bad}))
            want[f"{c} {bad!r}"] = noun
        for bad in {"": [], ">= 0": ["-0.01"], "> 0": ["0", "-2"], "<= as_of": ["2023-06-01 00:00:01"]}[bound]:
            rows.append((f"{c} {bad}", good | {c: bad}))
            want[f"{c} {bad}"] = f"{c} {R.MEANING[bound]}"
    rows.append(("all", dict.fromkeys(good)))
    want["all"] = "; ".join(f"{c} must be {'an' if k in ('integer', 'amount') else 'a'} {k}" for c, k, _ in rules if not k.startswith("optional"))
    df = spark.createDataFrame([(k, *[r[c] for c in good]) for k, r in rows], ", ".join(f"{c} string" for c in ["row_key", *good]))
    got = {r["row_key"]: r for r in R.validate(df, rules, ["row_key"], "2023-06-01").collect()}
    assert {k: r["errors"] for k, r in got.items()} == want
    assert all(r["ok"] == (want[k] == "") for k, r in got.items())
    kept, held = R.quarantine(df, rules, "2023-06-01")
    assert kept.columns == df.columns and kept.count() + held.count() == len(rows)
    assert {r["row_key"]: r["errors"] for r in held.collect()} == {k: v for k, v in want.items() if v}
    report = {r["rule"]: r["n_broken"] for r in R.rule_report(df, rules, "2023-06-01").collect()}
    assert report == {m: sum(m in v.split("; ") for v in want.values()) for m, _ in R.broken(rules, "2023-06-01")}
    needed = {m for m, _ in R.broken([r for r in rules if "text" not in r[1] or not r[1].startswith("optional")], "2023-06-01")}
    assert all(report[m] > 0 for m in needed)
    assert R.validate(df.where(F.lit(False)), rules, ["row_key"], "2023-06-01").count() == 0
