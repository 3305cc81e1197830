"""Reading and writing the eight tables, feature tables, graphs and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlens import schema as S
from ringlens.operators.data_checks import combine

VARIANTS = ("baseline", "graph")
_EDGE_SCHEMA = "src string, dst string, edge_type string, weight bigint"
_NODE_SCHEMA = "id string, node_type string"


def normalize(name: str, df: DataFrame) -> DataFrame:
    """Blank instead of null for ring and promotion ids; unparseable times become null."""
    if "timestamp" in df.columns and dict(df.dtypes)["timestamp"] == "string":
        df = df.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    blanks = {"users": ("ring_id", "ring_type"), "transactions": ("promo_id", "ring_id")}.get(name, ())
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in blanks if c in df.columns})


def _text_schema(schema: T.StructType) -> T.StructType:
    """The CSV layout: times stay text, so that bad ones can be found instead of failing the read."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema
    ])


def load_tables(spark: SparkSession, folder: str, *, file_format: str = "csv") -> dict[str, DataFrame]:
    """All eight tables with declared schemas; a missing table is an error."""
    tables = {}
    for name, schema in S.TABLES.items():
        path = f"{folder.rstrip('/')}/{name}"
        if file_format == "csv":
            # An unquoted empty field and a quoted one both read as null; normalize() restores blanks.
            df = spark.read.schema(_text_schema(schema)).csv(path, header=True)
        else:
            df = spark.read.schema(schema).parquet(path)
        tables[name] = normalize(name, df)
    return tables


def write_tables(tables: Mapping[str, DataFrame], folder: str, *, file_format: str = "csv") -> DataFrame:
    """Write the tables and return ``(table, rows)``, counted from what was written."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        if file_format == "csv":
            out = df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")) if "timestamp" in df.columns else df
            out.write.csv(path, header=True)
            written = spark.read.schema(_text_schema(out.schema)).csv(path, header=True)
        else:
            df.write.parquet(path)
            written = spark.read.parquet(path)
        counts.append(written.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows"))
    return combine(counts)


def write_features(features: DataFrame, folder: str) -> DataFrame:
    """Both variants of a feature table partitioned by split; returns ``(variant, split, rows, columns)``."""
    spark, shapes = features.sparkSession, []
    for variant in VARIANTS:
        names = S.MODEL_FEATURES[variant]
        if not set(names) <= set(features.columns):
            continue
        path = f"{folder.rstrip('/')}/features_{variant}"
        features.select("user_id", *names, "label", "split").write.partitionBy("split").parquet(path)
        shapes.append(
            spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(variant).alias("variant"), "split", "rows", F.lit(len(names) + 2).alias("columns"))
        )
    return combine(shapes)


def load_features(spark: SparkSession, folder: str, variant: str, split: str | None = None) -> DataFrame:
    """One feature table; a split reads only its own files."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    table = spark.read.parquet(f"{folder.rstrip('/')}/features_{variant}")
    return table if split is None else table.where(F.col("split") == split)


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as JSON in a stable order: smaller id first in an edge, then sorted."""
    ordered = edges.selectExpr("least(src, dst) AS src", "greatest(src, dst) AS dst", "edge_type", "weight")
    nodes.select("id", "node_type").orderBy("id", "node_type").write.json(f"{folder.rstrip('/')}/nodes")
    ordered.orderBy("src", "dst", "edge_type").write.json(f"{folder.rstrip('/')}/edges")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.schema(_NODE_SCHEMA).json(f"{folder.rstrip('/')}/nodes")
    edges = spark.read.schema(_EDGE_SCHEMA).json(f"{folder.rstrip('/')}/edges")
    return nodes, edges


def dataset_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, rows, columns)`` per table."""
    return combine([
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.array(*[F.lit(c) for c in df.columns]).alias("columns"))
        for name, df in tables.items()
    ])


def write_report(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").json(path)
    return path
