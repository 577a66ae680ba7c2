"""File sources and sinks.

Paths are shared-storage locations; scratch output goes under the cluster's
``spark.checkpoint.dir`` (see ``scratch_path``), never a machine-local folder.
"""

from __future__ import annotations

import uuid
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerlake.session import ensure_checkpoint_dir

# Fixed value: the retail file is comma-separated, every other export uses ';'.
RETAIL_FILE_MARKER = "savs.csv"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerlake-out/{name}-{uuid.uuid4().hex[:12]}"


def load_csv(spark: SparkSession, path: str, schema=None, sep: str | None = None) -> DataFrame | None:
    """Read a CSV export with a header; ';' separated unless the path is
    the retail file (','). Returns None when the path cannot be read."""
    sep = sep or ("," if RETAIL_FILE_MARKER in path else ";")
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8")
    reader = reader.schema(schema) if schema is not None else reader
    try:
        return reader.csv(path)
    except AnalysisException:
        return None


def load_tables(spark: SparkSession, base: str, names: Sequence[str], fmt: str = "parquet") -> dict:
    """Read named cleaned tables; a missing one maps to None."""
    out = {}
    for n in names:
        try:
            out[n] = spark.read.format(fmt).load(f"{base.rstrip('/')}/{n}.{fmt}")
        except AnalysisException:
            out[n] = None
    return out


def union_exports(frames: Sequence[DataFrame]) -> DataFrame:
    """S3: stack exports positionally under the first one's column names."""
    first = frames[0]
    out = first
    for f in frames[1:]:
        out = out.union(f.toDF(*first.columns))
    return out


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               sep: str = ";") -> str:
    """Write a table (CSV with header or Parquet)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("sep", sep).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def save_insights(spark: SparkSession, tables: Mapping[str, DataFrame], out_dir: str,
                  scalars: Mapping[str, DataFrame] | None = None, fmt: str = "parquet") -> DataFrame:
    """One output per table; one-row KPI frames flattened into a long
    (metric, value) summary that is written too and returned."""
    for name, df in tables.items():
        save_table(df, f"{out_dir}/{name}", fmt)
    from ledgerlake.operators.common import kpi_long
    summary = None
    for prefix, df in (scalars or {}).items():
        long = kpi_long(df).withColumn("metric", F.col("metric"))
        summary = long if summary is None else summary.unionByName(long)
    if summary is not None:
        save_table(summary, f"{out_dir}/summary", fmt)
        return spark.read.format(fmt).load(f"{out_dir}/summary")
    return spark.createDataFrame([], "metric string, value double")


def feedback_append(feedback: DataFrame, path: str) -> None:
    """Append (timestamp, question, answer, feedback) rows to the JSON log."""
    feedback.select(F.col("timestamp").cast("string"), "question", "answer", "feedback") \
            .write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp string, question string, answer string, feedback string").json(path)


def summary_lines(kpis: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """S7: '- metric: value' text lines from the long KPI table (6 decimals)."""
    return kpis.select(F.concat(F.lit("- "), F.col(metric), F.lit(": "),
                                F.format_string("%.6f", F.col(value))).alias("line"),
                       F.col(metric).alias("metric"))


def tables_as_documents(spark: SparkSession, tables: Mapping[str, DataFrame], rows_per_doc: int = 200,
                        overview: str | None = None) -> DataFrame:
    """Documents (source, doc_ix, content) made from analysis tables.

    Each distinct row becomes a JSON line (suffixed ' xN' when it occurs N
    > 1 times); a table is split into ceil(rows / rows_per_doc) documents by
    a hash of the line, so no document (group) grows with the table. Lines
    inside a document are sorted. A fixed overview document is added when
    ``overview`` is given.
    """
    docs = None
    for name, df in tables.items():
        line = F.to_json(F.struct(*df.columns))
        n_docs = F.greatest(F.ceil(df.select(F.count(F.lit(1))).scalar() / F.lit(float(rows_per_doc))),
                            F.lit(1))
        # identical rows collapse into one line with their multiplicity, so a
        # heavily repeated row cannot pile up in one document
        rows = df.select(line.alias("_l")).groupBy("_l").agg(F.count(F.lit(1)).alias("_c")) \
                 .select(F.when(F.col("_c") > 1, F.concat("_l", F.lit(" x"), F.col("_c").cast("string")))
                          .otherwise(F.col("_l")).alias("_line"))
        rows = rows.withColumn("doc_ix", F.pmod(F.xxhash64("_line"), n_docs).cast("long"))
        d = rows.groupBy("doc_ix").agg(F.array_sort(F.collect_list("_line")).alias("_lines")) \
                .select(F.lit(name).alias("source"), "doc_ix",
                        F.concat_ws("\n", "_lines").alias("content"))
        docs = d if docs is None else docs.unionByName(d)
    if overview is not None:
        ov = spark.createDataFrame([("dataset_overview", 0, overview)], "source string, doc_ix long, content string")
        docs = ov if docs is None else docs.unionByName(ov)
    return docs
