"""Access policy: who may do what, and log rows the policy does not cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake import reference_data as ref
from carelake.schemas import local_rows

_RULE = "principal string, permissions string, scope string"


def policy_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grants, denies and the object catalog as small tables."""
    objects = [(s, f"{s}.{o}") for s, names in ref.CATALOG.items() for o in names]
    return (local_rows(spark, ref.GRANTS, _RULE), local_rows(spark, ref.DENIES, _RULE),
            local_rows(spark, objects, "schema_name string, object_name string"))


def _expanded(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per principal, object and permission; schema rules cover every
    object of their schema."""
    single = rules.select("principal", F.explode(F.split("permissions", " ")).alias("permission"), "scope")
    by_schema = single.join(catalog, single["scope"] == catalog["schema_name"])
    by_object = single.join(catalog, single["scope"] == catalog["object_name"])
    keep = ["principal", "object_name", "permission"]
    return by_schema.select(*keep).unionByName(by_object.select(*keep)).distinct()


def effective_access(grants: DataFrame, denies: DataFrame, catalog: DataFrame) -> DataFrame:
    """Granted and not denied; a deny at either level wins."""
    keys = ["principal", "object_name", "permission"]
    return _expanded(grants, catalog).join(_expanded(denies, catalog), keys, "left_anti")


def access_audit(log: DataFrame, access: DataFrame) -> DataFrame:
    """Log rows for which no access exists.

    The policy table holds at most principals x objects x permissions rows
    and the log side is never shuffled on a hot principal: Catalyst
    broadcasts the policy by its measured size.
    """
    return log.join(access, ["principal", "object_name", "permission"], "left_anti")


def mask_bulk_patient(df: DataFrame, hash_cols: list[str], null_cols: list[str] = ()) -> DataFrame:
    """Hide the patient columns of a bulk export; whether it is one, the caller knows."""
    for c in hash_cols:
        df = df.withColumn(c, F.sha2(F.col(c).cast("string"), 256))
    for c in null_cols:
        df = df.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    return df
