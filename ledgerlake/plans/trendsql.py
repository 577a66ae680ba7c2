"""DuckDB twins of the trend-and-season fit, the hold-out selection and the forecasts.

Each function gives CTEs over a CTE ``panel`` (series_id, period, y); sums are of whole
numbers and all later steps are the operators' own, in their order.
"""

from __future__ import annotations

from ledgerlake.operators import forecast as FC

K = 4


def _wave(a, b, period: str) -> str:
    def pick(v):
        return f"list_extract({list(v)}, month({period})::BIGINT)"
    return f"(({pick(a)} + {pick(b)} * {FC.ROOT3}::DOUBLE) / 2.0)"


def line(t: str, period: str) -> str:
    return f"(b0 + b1 * {t} + b2 * {_wave(FC.SIN_A, FC.SIN_B, period)} + b3 * {_wave(FC.COS_A, FC.COS_B, period)})"


def fit(src: str, name: str, places: int, min_points: int) -> str:
    """CTE ``name``: series_id, n, t_last, p_last, b0..b3, sigma of the rows of ``src``
    (series_id, period, y, t)."""
    def month(v):
        return f"list_extract({list(v)}, month(period)::BIGINT)::BIGINT"

    def d(c):
        return f"{c}::DOUBLE"

    def half(a, b):
        return f"({a}::DOUBLE + {b}::DOUBLE * {FC.ROOT3}::DOUBLE) / 2.0"

    unit = f"{10 ** places}.0::DOUBLE"
    waves = "".join(f", sum({n}) AS s{n}, sum(t * {n}) AS t{n}, sum(c * {n}) AS c{n}" for n in "abuv")
    out = f"""{name}_0 AS (SELECT series_id, period, t::BIGINT AS t, round_even(y * {unit}, 0)::HUGEINT AS c, {month(FC.SIN_A)} AS a, {month(FC.SIN_B)} AS b,
  {month(FC.COS_A)} AS u, {month(FC.COS_B)} AS v FROM {src}),
{name}_1 AS (SELECT series_id, count(*) AS n, max(t) AS t_last, max(period) AS p_last, sum(t) AS st, sum(t * t) AS tt, sum(c) AS sc, sum(t * c) AS tc, sum(c * c) AS cc,
  sum(a * a + 3 * b * b) AS ss, sum(u * u + 3 * v * v) AS uu, sum(a * u + 3 * b * v) AS au, sum(a * v + b * u) AS av{waves}
  FROM {name}_0 GROUP BY 1 HAVING count(*) >= {min_points}),
{name}_s AS (SELECT series_id, n, t_last, p_last, {d('cc')} AS yy, {d('n')} AS m00, {d('st')} AS m01, {half('sa', 'sb')} AS m02, {half('su', 'sv')} AS m03,
  {d('tt')} AS m11, {half('ta', 'tb')} AS m12, {half('tu', 'tv')} AS m13, {d('ss')} / 4.0 AS m22, ({d('au')} + {d('av')} * {FC.ROOT3}::DOUBLE) / 4.0 AS m23, {d('uu')} / 4.0 AS m33,
  {d('sc')} AS r0, {d('tc')} AS r1, {half('ca', 'cb')} AS r2, {half('cu', 'cv')} AS r3 FROM {name}_1),
{name}_d0 AS (SELECT *, {', '.join(f'm{i}{i} AS d{i}' for i in range(K))} FROM {name}_s)"""
    at = f"{name}_d0"
    for i in range(K):
        ok = f"m{i}{i} > {FC.PIVOT}::DOUBLE * d{i}"
        got = [f"CASE WHEN {ok} THEN m{i}{j} / m{i}{i} ELSE 0.0 END AS f{i}{j}" for j in range(i + 1, K)] + [f"CASE WHEN {ok} THEN r{i} / m{i}{i} ELSE 0.0 END AS g{i}"]
        out += f",\n{name}_f{i} AS (SELECT *, {', '.join(got)} FROM {at})"
        at = f"{name}_f{i}"
        new = [f"m{x}{y} - f{i}{x} * m{i}{y} AS m{x}{y}" for x in range(i + 1, K) for y in range(x, K)] + [f"r{x} - f{i}{x} * r{i} AS r{x}" for x in range(i + 1, K)]
        if new:
            out += f",\n{name}_e{i} AS (SELECT * REPLACE ({', '.join(new)}) FROM {at})"
            at = f"{name}_e{i}"
    for i in reversed(range(K)):
        x = f"g{i}" + "".join(f" - f{i}{j} * b{j}" for j in range(i + 1, K))
        out += f",\n{name}_b{i} AS (SELECT *, {x} AS b{i} FROM {at})"
        at = f"{name}_b{i}"
    sse = "yy" + "".join(f" - r{i} * g{i}" for i in range(K))
    return out + f""",
{name} AS (SELECT series_id, n, t_last, p_last, {', '.join(f'b{i} / {unit} AS b{i}' for i in range(K))},
  sqrt(greatest({sse}, 0.0) / greatest(n::DOUBLE - {K}, 1.0)) / {unit} AS sigma FROM {at})"""


PT = "pt AS (SELECT series_id, period, y, datediff('month', min(period) OVER (PARTITION BY series_id), period) AS t FROM panel)"


def trend_forecast(places: int, horizon: int = 6, min_points: int = 12) -> str:
    """CTEs ``pt``, ``fit`` and ``trend`` (unrounded)."""
    return f"""{PT},
{fit('pt', 'fit', places, min_points)},
fut AS (SELECT *, (p_last + to_months(h::INTEGER))::DATE AS period, t_last::DOUBLE + h AS t FROM fit, (SELECT unnest(range(1, {horizon + 1})) AS h)),
trend AS (SELECT series_id, period, h::INTEGER AS h, {line('t', 'period')} AS yhat, {FC.Z_95}::DOUBLE * sigma AS band FROM fut)"""


def selection(places: int, min_points: int = 12, frac: float = 0.2) -> str:
    """CTEs after ``pt``: ``sel`` (series_id, model, n, mae, rmse, mape, r2, chosen)."""
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period) AS rn, count(*) OVER (PARTITION BY series_id) AS cnt FROM pt),
tr AS (SELECT * FROM ord WHERE rn <= floor(cnt * {1 - frac}::DOUBLE)),
te AS (SELECT * FROM ord WHERE rn > floor(cnt * {1 - frac}::DOUBLE)),
{fit('tr', 'trfit', places, min_points)},
pred AS (SELECT te.series_id, te.y, l.y AS yhat, 'naive' AS model FROM te JOIN (SELECT series_id, arg_max(y, period) AS y FROM tr GROUP BY 1) l USING (series_id)
  UNION ALL SELECT te.series_id, te.y, {line('te.t::DOUBLE', 'te.period')}, 'seasonal_trend' FROM te JOIN trfit USING (series_id)),
acc AS (SELECT series_id, model, count(*) AS n, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse,
  avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) AS mape, sum((y - yhat) * (y - yhat)) AS sse, var_pop(y) AS v FROM pred GROUP BY 1, 2),
rated AS (SELECT series_id, model, n, round_even(mae, 6) AS mae, round_even(sqrt(mse), 6) AS rmse, round_even(mape * 100, 6) AS mape,
  round_even(CASE WHEN v > 0 THEN 1 - sse / nullif(v * n, 0) END, 6) AS r2 FROM acc),
sel AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse ASC NULLS LAST, model) = 1 AS chosen FROM rated)"""


def best(horizon: int = 6) -> str:
    """CTE ``best`` after ``trend`` and ``sel``: the forecast of each series' chosen model."""
    return f"""bt AS (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY period) AS e FROM panel),
q AS (SELECT series_id, round_even(quantile_cont(e, 0.025), 6) AS lo, round_even(quantile_cont(e, 0.975), 6) AS hi FROM bt WHERE e IS NOT NULL GROUP BY 1),
last AS (SELECT series_id, max(period) AS p, arg_max(y, period) AS y FROM panel GROUP BY 1),
best AS (SELECT series_id, (p + to_months(h::INTEGER))::DATE AS period, h::INTEGER AS h, round_even(y, 6) AS yhat, round_even(y + lo, 6) AS yhat_lower, round_even(y + hi, 6) AS yhat_upper, 'naive' AS model
  FROM last LEFT JOIN q USING (series_id), (SELECT unnest(range(1, {horizon + 1})) AS h) WHERE series_id IN (SELECT series_id FROM sel WHERE chosen AND model = 'naive')
  UNION ALL SELECT series_id, period, h, round_even(round_even(yhat, 6), 6), round_even(round_even(yhat - band, 6), 6), round_even(round_even(yhat + band, 6), 6), 'seasonal_trend' FROM trend
  WHERE series_id IN (SELECT series_id FROM sel WHERE chosen AND model = 'seasonal_trend'))"""
