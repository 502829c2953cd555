"""Shapes of physical plans that must hold whatever the data size."""

from carelake.plans import procedures as proc


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_prunes_years_and_reaches_the_scan(spark, wh):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(proc.get_claims_summary(wh.view("vw_ClaimsSummary"), "1997-03-01", "1998-10-31", "Medicare", top_n=100))
    assert "TakeOrderedAndProject" in text
    assert "PartitionFilters: [isnotnull(ServiceYear" in text and "ServiceYear#" in text
    assert "EqualTo(PayerType,Medicare)" in text and "GreaterThanOrEqual(ServiceDate" in text


def test_measure_reads_only_its_columns(wh):
    from carelake.plans.measures import evaluate
    text = plan(evaluate(wh.view("vw_ClaimsSummary"), ["Total Billed"], ["PayerType"]))
    assert "ReadSchema: struct<BilledAmount:decimal(10,2),PayerType:string>" in text
    assert text.count("Exchange") == 1


def test_provider_claims_are_summed_before_the_provider_join(wh):
    from carelake.plans.views import vw_provider_performance
    lines = plan(vw_provider_performance(wh.view_tables("vw_ProviderPerformance"))).splitlines()
    join = next(i for i, x in enumerate(lines) if "Join" in x and "ProviderKey" in x)
    assert any("HashAggregate" in x and "ProviderKey" in x for x in lines[join:])
