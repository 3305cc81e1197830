"""Tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ringlens.session import cut_lineage, shared_folder

__all__ = ["cut_lineage", "free_names", "read_documents", "read_table", "row_hash", "shared_folder"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from every column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        free.append(name)
    return free


def row_hash(docs: DataFrame) -> Column:
    """Two 64-bit hashes of all columns of a row; rows that agree in every column agree in it."""
    parts = []
    for field in docs.schema:
        column = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, ArrayType | MapType | StructType)
        parts += [column.isNull(), F.to_json(F.struct(column), {"ignoreNullFields": "false"}) if nested else column]
    return F.concat_ws(":", *[F.xxhash64(F.lit(seed), *parts).cast("string") for seed in (1, 2)])
