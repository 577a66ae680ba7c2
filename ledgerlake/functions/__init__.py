"""Column-expression helpers (all JVM-side, codegen-friendly)."""
from ledgerlake.functions.columns import *  # noqa: F401,F403
