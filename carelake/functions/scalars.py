"""Column expressions of the warehouse.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation; there is no Python UDF in this package.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from carelake import reference_data as ref

TOTAL = "decimal(38,2)"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- casts -------------------------------------------------------------------

def to_date_lenient(col) -> Column:
    """ISO dates and compact ``yyyyMMdd`` dates; anything else is NULL."""
    text = F.trim(_c(col))
    compact = F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd"))
    return F.coalesce(compact, text.try_cast("date"))


def typed_cast(col, dtype: str) -> Column:
    """Cast a string leniently: a value that does not fit becomes NULL.

    Blank text cast to an integer type is 0, as the source dialect defines.
    ``tinyint`` is the unsigned 0..255 kind and is stored as smallint.
    """
    c = _c(col)
    if dtype == "date":
        return to_date_lenient(c)
    if dtype == "datetime":
        return c.try_cast("timestamp_ntz")
    if dtype in ("tinyint", "smallint", "int"):
        base = "smallint" if dtype == "tinyint" else dtype
        # a failing integer cast raises inside the engine, so text is tested first
        value = F.when(c.rlike(INTEGER_TEXT), c.try_cast(base)).when(F.trim(c) == "", F.lit(0).cast(base))
        return F.when(value.between(0, 255), value) if dtype == "tinyint" else value
    return c.try_cast(dtype)


def date_key(col) -> Column:
    """``yyyymmdd`` as int, 0 when the text is NULL or not a date."""
    d = to_date_lenient(col)
    return F.coalesce(F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d), F.lit(0))


def blank_to_null(col) -> Column:
    return F.nullif(_c(col), F.lit(""))


# --- derived columns ---------------------------------------------------------

def full_name(first, last) -> Column:
    blank = F.lit("")
    return F.concat(F.coalesce(_c(first), blank), F.lit(" "), F.coalesce(_c(last), blank))


def write_off(allowed, paid) -> Column:
    return _c(allowed) - _c(paid)


def deviation_from_mid(value, low, high) -> Column:
    """Distance from the middle of the range; NULL unless both bounds exist."""
    mid = ((_c(low) + _c(high)) / F.lit(2).cast("decimal(1,0)")).cast("decimal(12,4)")
    return F.when(_c(low).isNotNull() & _c(high).isNotNull(), _c(value) - mid)


def total_cost(patient, payer) -> Column:
    zero = F.lit(0).cast("decimal(10,2)")
    return F.coalesce(_c(patient), zero) + F.coalesce(_c(payer), zero)


def age_years(born, on) -> Column:
    """Difference of the year numbers, birthdays ignored."""
    return F.year(_c(on)) - F.year(_c(born))


def age_band(age, labels=ref.AGE_BANDS) -> Column:
    """Five bands; a missing age counts as the lowest."""
    a = _c(age)
    band = F.when(a.isNull(), labels[0])
    for limit, label in zip(ref.AGE_LIMITS, labels):
        band = band.when(a <= limit, label)
    return band.otherwise(labels[-1])


def abnormal_flag(value, low, high) -> Column:
    v, lo, hi = _c(value), _c(low), _c(high)
    return (F.when(v < lo, "Low")
             .when(v > hi * F.lit(1.5).cast("decimal(2,1)"), "Critical")
             .when(v > hi, "High")
             .otherwise("Normal"))


def fiscal_year(date) -> Column:
    return F.year(_c(date))


def fiscal_quarter(date) -> Column:
    return F.quarter(_c(date))


def paid_amount_rule(status, allowed, share) -> Column:
    """Only approved claims are paid: the allowed amount times the share."""
    zero = F.lit(0).cast("decimal(10,2)")
    return F.when(_c(status) == "Approved", (_c(allowed) * _c(share)).cast("decimal(10,2)")).otherwise(zero)


def week_of_year(date) -> Column:
    """Weeks start on Sunday and week 1 is the one holding January 1st."""
    d = _c(date)
    shift = F.dayofweek(F.trunc(d, "YEAR")) - 2
    return F.floor((F.dayofyear(d) + shift) / 7) + 1


def date_parts(date) -> dict[str, Column]:
    d = _c(date)
    weekday = F.dayofweek(d)
    return {
        "DayOfWeek": weekday.cast("smallint"),
        "DayName": F.date_format(d, "EEEE"),
        "DayOfMonth": F.dayofmonth(d).cast("smallint"),
        "DayOfYear": F.dayofyear(d).cast("smallint"),
        "WeekOfYear": week_of_year(d).cast("smallint"),
        "MonthNumber": F.month(d).cast("smallint"),
        "MonthName": F.date_format(d, "MMMM"),
        "Quarter": F.quarter(d).cast("smallint"),
        "QuarterName": F.concat(F.lit("Q"), F.quarter(d)),
        "Year": F.year(d).cast("smallint"),
        "IsWeekend": weekday.isin(1, 7),
        "FiscalYear": fiscal_year(d).cast("smallint"),
        "FiscalQuarter": fiscal_quarter(d).cast("smallint"),
    }


def safe_divide(num, den, alt=0.0) -> Column:
    """Division as double; a zero or missing divisor gives ``alt``."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(d.isNull() | (d == 0), F.lit(alt)).otherwise(n / d)


def timeline_detail_lab(test, value, unit) -> Column:
    """NULL when any part is NULL."""
    return F.concat(_c(test), F.lit(" = "), _c(value).cast("string"), F.lit(" "), _c(unit))


def timeline_detail_drug(drug, dosage, frequency) -> Column:
    return F.concat(_c(drug), F.lit(" "), _c(dosage), F.lit(" — "), _c(frequency))


# --- usage log and answer cache ----------------------------------------------

def cache_hit_pct(cached, total_input) -> Column:
    """Share of the input tokens that came from the cache, in percent."""
    return F.when(_c(total_input) > 0, _c(cached).cast("double") / _c(total_input) * 100).otherwise(F.lit(0.0))


def request_date(ts) -> Column:
    return F.to_date(_c(ts))


def request_hour(ts) -> Column:
    return F.hour(_c(ts))


def total_tokens(tokens_in, tokens_out) -> Column:
    return _c(tokens_in) + _c(tokens_out)


def request_key(agent, query) -> Column:
    """Cache key: SHA-256 over the agent and the normalised question, which is
    lower-cased and freed of white space at both ends."""
    stripped = F.regexp_replace(_c(query), r"(?U)^\s+|\s+$", "")
    return F.sha2(F.concat(_c(agent), F.lit("::"), F.lower(stripped)), 256)


def clip_text(col, n: int) -> Column:
    return F.substring(_c(col), 1, n)


def snake_agent_name(col) -> Column:
    """``ETLAgent`` -> ``etl_agent``, ``ClaimsAgent`` -> ``claims_agent``."""
    split_acronym = F.regexp_replace(_c(col), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(split_acronym, "([a-z])([A-Z])", "$1_$2"))


def cosine_unit(a, b) -> Column:
    """Cosine of two unit vectors, i.e. their dot product in double."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


# --- claim interchange text ---------------------------------------------------

def edi_date(col) -> Column:
    return F.regexp_replace(_c(col), "-", "")


def edi_code(col) -> Column:
    return F.regexp_replace(_c(col), r"\.", "")


def edi_id(col, n: int | None = None) -> Column:
    """An id as an element: whole, unless the caller asks for its first ``n`` characters."""
    return _c(col) if n is None else F.substring(_c(col), 1, n)


# --- SQL surface ---------------------------------------------------------------

def register_sql_functions(spark: SparkSession) -> None:
    """Offer ``fn_DateKey`` to SQL users; Spark inlines the body in the plan."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION fn_DateKey(d STRING) RETURNS INT
        RETURN coalesce(
            cast(date_format(coalesce(
                if(length(trim(d)) = 8, try_to_date(trim(d), 'yyyyMMdd'), NULL),
                try_cast(trim(d) AS DATE)), 'yyyyMMdd') AS INT), 0)
    """)
