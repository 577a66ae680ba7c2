"""Small DuckDB SQL fragments shared by the oracles."""


def spine(src: str, col: str = "period", step: str = "1 MONTH") -> str:
    """CTE body: every period from min(col) to max(col) of ``src``."""
    return (f"SELECT CAST(unnest(generate_series(CAST(min({col}) AS TIMESTAMP), "
            f"CAST(max({col}) AS TIMESTAMP), INTERVAL {step})) AS DATE) AS {col} FROM {src}")


def month(c: str = "date") -> str:
    return f"CAST(date_trunc('month', {c}) AS DATE)"
