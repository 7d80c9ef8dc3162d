"""Deliveries: checksums, duplicate files, repeated requests, raw payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("file_hash"))


def checksum_valid(column: str) -> Column:
    return F.coalesce(F.col(column).rlike("^[0-9a-f]{64}$"), F.lit(False))


def gate_duplicates(candidates: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates with ``accepted`` and ``duplicate_of``: the registered batch.

    Sales files are compared by hash alone, dataset versions by type, period
    and hash; pass the key columns accordingly.
    """
    known = registry.groupBy(*keys).agg(F.min("batch_id").alias("duplicate_of"))
    return candidates.join(known, list(keys), "left").withColumn("accepted", F.col("duplicate_of").isNull())


def accepted_files(candidates: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(registry.select(*keys).distinct(), list(keys), "left_anti")


def restage_outcome(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """NEW, RETURN_STORED or REJECTED for a staging request by batch id.

    The same id may be staged again only with the same type, mode and hash.
    """
    stored = batches.select(
        "batch_id", F.col("entity_type").alias("_type"), F.col("import_mode").alias("_mode"), F.col("file_hash").alias("_hash")
    )
    same = (
        F.col("entity_type").eqNullSafe(F.col("_type"))
        & F.col("import_mode").eqNullSafe(F.col("_mode"))
        & F.col("file_hash").eqNullSafe(F.col("_hash"))
    )
    outcome = F.when(F.col("_hash").isNull() & F.col("_type").isNull(), "NEW").when(same, "RETURN_STORED").otherwise("REJECTED")
    return requests.join(stored, "batch_id", "left").withColumn("outcome", outcome).drop("_type", "_mode", "_hash")


def raw_payload(rows: DataFrame, columns: Sequence[str]) -> Column:
    """JSON of the source columns: decimals as plain text, dates as ISO text."""
    fields = []
    for name in columns:
        kind = rows.schema[name].dataType
        if isinstance(kind, T.DecimalType):
            value = F.col(name).cast("string")
        elif isinstance(kind, T.DateType):
            value = F.date_format(name, "yyyy-MM-dd")
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            value = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
        else:
            value = F.col(name)
        fields.append(value.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
