import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from carelake.functions import predicates as pred
from carelake.functions import scalars as fn


def value(spark, column, **row):
    ddl = ", ".join(f"{k} {t}" for k, (t, _) in row.items()) or "x int"
    df = spark.createDataFrame([tuple(v for _, v in row.values()) or (1,)], ddl)
    return df.select(column.alias("v")).first()[0]


@pytest.mark.parametrize("text,key", [
    ("2024-03-05", 20240305), ("20240305", 20240305), ("2024-02-30", 0), (None, 0), ("", 0), ("soon", 0)])
def test_date_key(spark, text, key):
    assert value(spark, fn.date_key("d"), d=("string", text)) == key


def test_date_key_in_sql(spark):
    fn.register_sql_functions(spark)
    got = spark.sql("SELECT fn_DateKey('20240305'), fn_DateKey('2024-02-30'), fn_DateKey(NULL)").first()
    assert tuple(got) == (20240305, 0, 0)


@pytest.mark.parametrize("text,dtype,want", [
    ("255", "tinyint", 255), ("256", "tinyint", None), ("-1", "tinyint", None), ("", "smallint", 0),
    ("1.5", "smallint", None), ("abc", "smallint", None), (None, "smallint", None), (" 7 ", "smallint", 7),
    ("40000", "smallint", None), ("12.345", "decimal(10,2)", Decimal("12.35")), ("x", "decimal(10,2)", None),
    ("12345678901.5", "decimal(10,2)", None), ("2024-01-02 03:04:05", "datetime", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("never", "datetime", None), ("2024-01-02", "date", dt.date(2024, 1, 2))])
def test_typed_cast(spark, text, dtype, want):
    assert value(spark, fn.typed_cast("c", dtype), c=("string", text)) == want


@pytest.mark.parametrize("v,flag", [("11", "Low"), ("15", "Normal"), ("18", "High"), ("27", "Critical")])
def test_abnormal_flag(spark, v, flag):
    num = lambda x: F.lit(x).cast("decimal(10,2)")
    assert value(spark, fn.abnormal_flag(num(v), num("12"), num("17.5"))) == flag


@pytest.mark.parametrize("age,band", [
    (None, "0–18"), (-3, "0–18"), (18, "0–18"), (19, "19–35"), (50, "36–50"), (65, "51–65"), (66, "65+")])
def test_age_band(spark, age, band):
    assert value(spark, fn.age_band("a"), a=("int", age)) == band


def test_age_is_difference_of_years(spark):
    born, on = F.lit("2000-12-31").cast("date"), F.lit("2001-01-01").cast("date")
    assert value(spark, fn.age_years(born, on)) == 1


def test_deviation(spark):
    row = dict(v=("decimal(10,3)", Decimal("7.25")), lo=("decimal(10,3)", Decimal("12")),
               hi=("decimal(10,3)", Decimal("17.5")), none=("decimal(10,3)", None))
    assert value(spark, fn.deviation_from_mid("v", "lo", "hi"), **row) == Decimal("-7.5")
    assert value(spark, fn.deviation_from_mid("v", "none", "hi"), **row) is None


def test_text_rules(spark):
    assert value(spark, fn.full_name("f", "l"), f=("string", None), l=("string", "Doe")) == " Doe"
    assert value(spark, fn.timeline_detail_lab("t", "v", "u"), t=("string", "A"), v=("int", 1),
                 u=("string", None)) is None
    assert value(spark, fn.blank_to_null("x"), x=("string", "")) is None


@pytest.mark.parametrize("day,week", [
    ("2024-01-01", 1), ("2024-01-06", 1), ("2024-01-07", 2), ("2023-01-01", 1), ("2023-01-08", 2), ("2022-12-31", 53)])
def test_week_of_year(spark, day, week):
    assert value(spark, fn.week_of_year(F.lit(day).cast("date"))) == week


@pytest.mark.parametrize("agent,name", [
    ("ClaimsAgent", "claims_agent"), ("ETLAgent", "etl_agent"), ("OrchestratorAgent", "orchestrator_agent")])
def test_snake_agent_name(spark, agent, name):
    assert value(spark, fn.snake_agent_name("a"), a=("string", agent)) == name


def test_request_key_normalises(spark):
    import hashlib
    want = hashlib.sha256(b"ClaimsAgent::what is the rate?").hexdigest()
    got = value(spark, fn.request_key(F.lit("ClaimsAgent"), F.lit("\n  What is the RATE?\t ")))
    assert got == want


def test_safe_divide(spark):
    assert value(spark, fn.safe_divide(F.lit(1), F.lit(0))) == 0.0
    assert value(spark, fn.safe_divide(F.lit(1), F.lit(None).cast("int"))) == 0.0
    assert value(spark, fn.safe_divide(F.lit(1), F.lit(4))) == 0.25


@pytest.mark.parametrize("sql,reasons", [
    ("SELECT 1; EXEC xp_cmdshell 'x'", [pred.STACKED, pred.BLOCKED_WORD]),
    ("SELECT * FROM t -- ; EXEC", []), ("  select 1 ;  ", []), ("DROP TABLE dw.FactClaims", [pred.NOT_SELECT, pred.DW_WRITE]),
    ("DELETE FROM stg.Claims", [pred.NOT_SELECT, pred.DELETE_ALL]),
    ("DELETE FROM stg.Claims WHERE x = 1", [pred.NOT_SELECT]),
    ("SELECT * FROM OPENROWSET('x')", [pred.BLOCKED_WORD])])
def test_statement_reasons(spark, sql, reasons):
    assert value(spark, pred.statement_reasons("s"), s=("string", sql)) == reasons
