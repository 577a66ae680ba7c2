"""ledgerlake: commerce analytics as lazy Spark DataFrame operators.

Every operator is ``op(df, *, keyword parameters) -> DataFrame`` built from
the DataFrame/SQL API, so Catalyst plans it and executors run it.
"""

__version__ = "0.1.0"
