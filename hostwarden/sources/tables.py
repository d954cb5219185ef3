"""Typed sources, batch and streaming. The same shaping code serves both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwarden import schema

SCHEMAS = {
    "events": schema.EVENT_DDL,
    "process_snapshots": schema.PROCESS_SNAPSHOT_DDL,
    "connection_snapshots": schema.CONNECTION_SNAPSHOT_DDL,
    "file_snapshots": schema.FILE_SNAPSHOT_DDL,
    "resource_samples": schema.RESOURCE_SAMPLE_DDL,
    "feedback": schema.FEEDBACK_DDL,
    "intel_abuse": schema.INTEL_ABUSE_DDL,
    "intel_geo": schema.INTEL_GEO_DDL,
    "intel_otx": schema.INTEL_OTX_DDL,
    "intel_malware": schema.INTEL_MALWARE_DDL,
}


def read_table(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Read one input table with its declared schema (no inference)."""
    return spark.read.schema(SCHEMAS[kind]).format(fmt).load(path)


def stream_table(
    spark: SparkSession, kind: str, path: str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """The same tables as a file stream."""
    reader = spark.readStream.schema(SCHEMAS[kind]).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def file_states_from_content(spark: SparkSession, paths: str | list[str], host_id: str, scan_ts) -> DataFrame:
    """File snapshot rows hashed from raw content; directories are never listed as rows."""
    return spark.read.format("binaryFile").load(paths).select(
        F.lit(host_id).alias("host_id"),
        F.lit(scan_ts).cast("timestamp").alias("scan_ts"),
        F.regexp_replace("path", "^file:", "").alias("path"),
        content_hash(F.col("content")).alias("hash"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
    )


def content_hash(content):
    """SHA-256 as lower-case hex."""
    return F.sha2(content, 256)


def conform_events(df: DataFrame) -> DataFrame:
    """Add missing event columns as nulls and put all of them in schema order."""
    have = set(df.columns)
    cols = []
    for f in schema.struct(schema.EVENT_DDL).fields:
        src = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(src.cast(f.dataType).alias(f.name))
    return df.select(*cols)
