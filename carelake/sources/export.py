"""Nested lab records and X12 837P claim text as Spark writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions.scalars import edi_code, edi_date, edi_id, typed_cast
from carelake.operators.keys import batch_numbering


def labs_nested(labs: DataFrame) -> DataFrame:
    """Flat staging labs to the nested exchange record."""
    return labs.select(
        "lab_id", "patient_id", "order_date",
        F.struct(
            "test_name", "loinc_code",
            F.col("result_value").alias("value"), F.col("result_unit").alias("unit"),
            F.struct(F.col("reference_range_low").alias("low"),
                     F.col("reference_range_high").alias("high")).alias("reference_range"),
            F.col("abnormal_flag").alias("flag"), "result_date",
        ).alias("result"),
    )


def export_labs_nested(labs: DataFrame, path: str | None = None) -> DataFrame:
    nested = labs_nested(labs)
    if path:
        nested.write.mode("overwrite").json(path)
    return nested


# Element texts of the interchange format.
SENDER = "CARELAKE       "
RECEIVER = "CLEARINGHOUSE  "
GROUP_SENDER = "CARELAKE"
GROUP_RECEIVER = "CLEARINGHS"
IMPLEMENTATION = "005010X222A1"
# The count that SE carries; the receiver's format gives 12 although 13 segments are sent.
SEGMENTS_PER_CLAIM = 12
# Longest id an element may hold.
ID_LENGTHS = {"claim_id": 20, "patient_id": 12, "provider_id": 10, "payer_id": 9}
# Staging columns the segments use.
CLAIM_FIELDS = ["claim_id", "patient_id", "provider_id", "payer_id", "claim_date", "service_date", "icd10_primary",
                "procedure_code", "billed_amount"]


def _padded(col: Column, width: int) -> Column:
    return F.lpad(col.cast("string"), width, "0")


def _segment(*elements) -> Column:
    """Elements keep their place: one without a value is empty."""
    parts = [F.lit(e) if isinstance(e, str) else F.coalesce(e.cast("string"), F.lit("")) for e in elements]
    return F.concat(F.concat_ws("*", *parts), F.lit("~"))


def claim_segments(no: Column) -> Column:
    """The segments of one claim as an array, in transmission order."""
    st_no = F.when(no < 10_000, _padded(no, 4)).otherwise(no.cast("string"))
    amount = typed_cast("billed_amount", "decimal(12,2)").cast("string")
    payer = edi_id("payer_id")
    service = edi_date("service_date")
    return F.array(
        _segment("ST", "837", st_no, IMPLEMENTATION),
        _segment("BHT", "0019", "00", st_no, edi_date("claim_date"), "1200", "CH"),
        _segment("NM1", "41", "2", GROUP_SENDER, "", "", "", "", "46", _padded(no, 10)),
        _segment("SBR", "P", "18", payer, payer, "", "", "", "CI"),
        _segment("NM1", "IL", "1", "PATIENT", "LAST", "", "", "", "", "MI", edi_id("patient_id")),
        _segment("CLM", edi_id("claim_id"), amount, "", "", "11:B:1", "Y", "A", "Y", "I"),
        _segment("DTP", "472", "D8", service),
        _segment("HI", F.when(F.col("icd10_primary").isNotNull(), F.concat(F.lit("ABK:"), edi_code("icd10_primary")))),
        _segment("NM1", "82", "1", "PROVIDER", "FIRST", "", "", "", "", "XX", edi_id("provider_id")),
        _segment("LX", "1"),
        _segment("SV1", F.concat(F.lit("HC:"), F.col("procedure_code")), amount, "UN", "1", "", "", "1"),
        _segment("DTP", "472", "D8", service),
        _segment("SE", str(SEGMENTS_PER_CLAIM), st_no),
    )


def edi_faults(claims: DataFrame) -> DataFrame:
    """Claims that an interchange cannot carry as they are: claim_id, reasons.

    A missing claim id, patient, service date, procedure or amount refuses the
    claim; an id longer than its element only reports it.
    """
    needed = {c: F.col(c).isNull() for c in ("claim_id", "patient_id", "procedure_code")}
    needed |= {"service_date": typed_cast("service_date", "date").isNull(), "billed_amount": typed_cast("billed_amount", "decimal(12,2)").isNull()}
    reasons = [F.when(test, f"no {c}") for c, test in needed.items()]
    reasons += [F.when(F.length(c) > n, f"long {c}") for c, n in ID_LENGTHS.items()]
    found = claims.select("claim_id", F.array_compact(F.array(*reasons)).alias("reasons"))
    return found.where(F.size("reasons") > 0).withColumn("refused", F.exists("reasons", lambda r: r.startswith("no ")))


def _complete(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("claim_id").isNotNull() & F.col("patient_id").isNotNull() & F.col("procedure_code").isNotNull()
                        & typed_cast("service_date", "date").isNotNull() & typed_cast("billed_amount", "decimal(12,2)").isNotNull())


def edi_837(claims: DataFrame, created: str, batch_size: int = 1000) -> DataFrame:
    """Claims to interchange lines ``(batch, position, segment)``.

    Header and trailer lines come from one small row per batch; claim lines
    stay one row per segment, so nothing larger than a batch is ever grouped.
    Claims that lack a mandatory element are left out; ``edi_faults`` names them.
    """
    day, clock = created.replace("-", "")[:8], created[11:16].replace(":", "")
    numbered = batch_numbering(_complete(claims).select(*CLAIM_FIELDS), "claim_id", batch_size)
    width = SEGMENTS_PER_CLAIM + 1
    lines = numbered.select(
        "batch", "no", F.posexplode(claim_segments(F.col("no"))).alias("seg", "segment")
    ).select("batch", (F.lit(2) + (F.col("no") - 1) * width + F.col("seg")).alias("position"), "segment")

    control = _padded(F.col("batch"), 9)
    blank = " " * 10
    tail = F.lit(2) + F.col("claims") * width
    line = lambda at, text: F.struct(at.cast("bigint").alias("position"), text.alias("segment"))
    frame = numbered.groupBy("batch").agg(F.count(F.lit(1)).alias("claims")).select(
        "batch",
        F.inline(F.array(
            line(F.lit(0), _segment("ISA", "00", blank, "00", blank, "ZZ", SENDER, "ZZ", RECEIVER, day[2:], clock,
                                    "^", "00501", control, "0", "P", ":")),
            line(F.lit(1), _segment("GS", "HC", GROUP_SENDER, GROUP_RECEIVER, day, clock,
                                    F.col("batch").cast("string"), "X", IMPLEMENTATION)),
            line(tail, _segment("GE", F.col("claims").cast("string"), F.col("batch").cast("string"))),
            line(tail + 1, _segment("IEA", "1", control)),
        )))
    return lines.unionByName(frame)


def export_edi_837(claims: DataFrame, created: str, path: str, batch_size: int = 1000,
                   folder_per_batch: bool = False) -> DataFrame:
    """Write the interchanges as text, each one whole and in order in one file.

    By default a file carries many interchanges; ``folder_per_batch`` gives
    every batch its own folder, which suits a small number of batches.
    """
    lines = edi_837(claims, created, batch_size)
    if folder_per_batch:
        ordered = lines.repartition("batch").sortWithinPartitions("batch", "position")
        ordered.select("batch", "segment").write.mode("overwrite").partitionBy("batch").text(path)
    else:
        ordered = lines.repartitionByRange("batch").sortWithinPartitions("batch", "position")
        ordered.select("segment").write.mode("overwrite").text(path)
    return lines
