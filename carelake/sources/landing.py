"""Landing files and staging frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.schemas import LAB_JSON_SCHEMA, NATURAL_ID, STAGING_COLUMNS, staging_schema


BAD_LINE = "_corrupt_record"


def landing_path(root: str, entity: str, run_date: str, extension: str = "csv") -> str:
    return f"{root.rstrip('/')}/{entity}/{entity}_{run_date}.{extension}"


def csv_reader(reader, entity: str):
    """Header CSV, every column a string, bad lines kept in ``_corrupt_record``."""
    schema = staging_schema(entity).add(BAD_LINE, T.StringType())
    return (reader.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD_LINE))


def read_landing_csv(spark: SparkSession, entity: str, run_date: str, root: str) -> DataFrame:
    return csv_reader(spark.read, entity).csv(landing_path(root, entity, run_date))


def read_labs_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested lab records to the flat staging columns.

    A single JSON array cannot be split, so it is read by one task per file;
    large feeds should land as JSON lines (``multi_line=False``).
    """
    raw = spark.read.schema(LAB_JSON_SCHEMA).option("multiLine", multi_line).json(path)
    nested = {
        "result_date": "result.result_date", "test_name": "result.test_name",
        "loinc_code": "result.loinc_code", "result_value": "result.value",
        "result_unit": "result.unit", "reference_range_low": "result.reference_range.low",
        "reference_range_high": "result.reference_range.high", "abnormal_flag": "result.flag",
    }
    absent = {"provider_id", "facility_id", "created_at"}
    return raw.select(*[
        F.lit(None).cast("string").alias(c) if c in absent else F.col(nested.get(c, c)).alias(c)
        for c in STAGING_COLUMNS["labs"]
    ])


def read_prescriptions_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(staging_schema("prescriptions")).option("multiLine", multi_line).json(path)


def stage(df: DataFrame, entity: str, source_file: str | None = None, loaded_at: str | None = None) -> DataFrame:
    """Staging frame: the entity's string columns and the four audit columns.

    The load id is a hash of the row and its file, so staging the same file
    again gives the same ids.  Lines the reader could not parse are left out;
    ``bad_lines`` returns them.
    """
    columns = STAGING_COLUMNS[entity]
    if BAD_LINE in df.columns:
        # always true: the reader must parse whole lines to tell bad ones, even for a count
        whole = F.octet_length(F.concat_ws("", *columns)) >= 0
        df = df.where(F.col(BAD_LINE).isNull() & whole)
    source = F.lit(source_file) if source_file is not None else F.col("_metadata.file_path")
    loaded = F.lit(loaded_at).cast("timestamp_ntz") if loaded_at else F.localtimestamp()
    return df.select(
        F.xxhash64(source, *[F.col(c) for c in columns]).alias("stg_load_id"),
        loaded.alias("stg_load_date"),
        source.alias("stg_source_file"),
        F.lit("Pending").alias("stg_status"),
        *[F.col(c).cast("string").alias(c) for c in columns],
    )


def bad_lines(df: DataFrame, entity: str, source_file: str | None = None) -> DataFrame:
    """Lines the reader could not parse: source_file, raw."""
    source = F.lit(source_file) if source_file is not None else F.col("_metadata.file_path")
    # what was parsed is named too, so that the reader looks at whole lines
    parsed = F.to_json(F.struct(*STAGING_COLUMNS[entity]))
    return df.where(F.col(BAD_LINE).isNotNull()).select(source.alias("source_file"), F.coalesce(BAD_LINE, parsed).alias("raw"))


def without_id(staged: DataFrame, entity: str) -> DataFrame:
    """Staged rows that have no natural id: source_file, raw (the row as JSON)."""
    return staged.where(F.col(NATURAL_ID[entity]).isNull()).select(
        F.col("stg_source_file").alias("source_file"), F.to_json(F.struct(*STAGING_COLUMNS[entity])).alias("raw"))


def load_manifest(tables: dict[str, DataFrame], run_date: str) -> DataFrame:
    """One row per entity: row count and status of the run."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count"))
          .select(F.lit(run_date).alias("run_date"), F.lit(name).alias("entity"), "row_count",
                  F.when(F.col("row_count") > 0, "ok").otherwise("empty").alias("status"))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
