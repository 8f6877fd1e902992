"""Counts by day against a count of all scans, after loads, repeats, verifications and compactions."""

from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.operators import dashboard as D
from cartonscope.operators import register as Q
from cartonscope.operators import rollups as R
from cartonscope.sources.daily_table import DailyTable, counted
from cartonscope.sources.results_table import ResultsTable
from tests.test_verification import accepted, open_keys, results, same

NOW = "2001-08-01 12:00:00"


def kept(df, path):
    """As it is now, whatever happens to the tables it comes from."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def register(spark, res, n):
    """Scans every seven hours before NOW, with the roll-up of their results."""
    at = spark.range(n).select(F.col("id"), (F.col("id") % 5).alias("product_id"),
                               (F.lit(NOW).cast("timestamp") - F.make_interval(hours=F.col("id").cast("int") * 7)).alias("created_at"))
    return at.join(R.rollup(res).withColumnRenamed("scan_id", "id"), "id").withColumn("scan_date", F.to_date("created_at"))


def test_days_equal_a_recount_after_loads_verifications_and_repeats(spark, tmp_path):
    base, keys = results(spark, 120), open_keys(spark, 120)
    stored = ResultsTable(spark, str(tmp_path / "results"), 8).create(base)
    scans, days = kept(register(spark, base, 120), tmp_path / "scans0"), DailyTable(spark, str(tmp_path / "days"))
    assert days.read().count() == 0 and days.compact() is None
    for load in range(3):
        assert days.add_scans(scans.filter(F.col("id") % 3 == load), load)
    assert not days.add_scans(scans.filter("id % 3 = 1"), 1)
    assert same(days.read(), counted(scans))
    # verifications alter status and score of some scans; their load runs twice, before and after compaction
    stored.apply(accepted(spark, keys[:40]), 1)
    assert days.add_verifications(stored, accepted(spark, keys[:40]), scans, 1, 3)
    now = kept(register(spark, stored.read().drop("bucket"), 120), tmp_path / "scans1")
    assert not same(counted(scans), counted(now)) and same(days.read(), counted(now))
    assert not days.add_verifications(stored, accepted(spark, keys[:40]), scans, 1, 3)
    stored.compact()
    assert days.compact() == 3 and days.compact() == 3
    assert not days.add_verifications(stored, accepted(spark, keys[:40]), scans, 1, 3)
    assert same(days.read(), counted(now)) and days._complete("deltas", "load") == []
    # a load after the compaction, and one that verifies scans of the load before again
    stored.apply(accepted(spark, keys[30:60]), 2)
    assert days.add_verifications(stored, accepted(spark, keys[30:60]), scans, 2, 4)
    now = kept(register(spark, stored.read().drop("bucket"), 120), tmp_path / "scans2")
    assert same(days.read(), counted(now))

    products = spark.createDataFrame([(i, f"name {i}") for i in range(4)], "id bigint, name string")
    got = days.read()
    assert same(D.total(got), R.total_scans(now)) and same(D.by_status(got), R.scans_by_status(now))
    assert same(D.clearance(got), R.clearance(now)) and same(D.score_bands(got), R.score_bands(now))
    assert same(D.daily_volume(got, now, NOW), R.daily_volume(now, NOW))
    whole = D.payload(got, now, products, NOW).collect()
    assert len(whole) == 1 and whole[0].total_scans == 120 and len(whole[0].trend) == K.TREND_DAYS
    assert [r.id for r in whole[0].recent_failures] == [r.id for r in Q.recent_noncompliant(now, products).orderBy(
        F.desc("created_at"), F.desc("id")).collect()]


def test_a_load_that_failed_midway_is_not_counted_and_may_run_again(spark, tmp_path):
    scans, days = register(spark, results(spark, 20), 20), DailyTable(spark, str(tmp_path / "days"))
    days.add_scans(scans.filter("id < 10"), 1)
    days.add_scans(scans.filter("id >= 10"), 2)
    (tmp_path / "days" / "deltas" / "load=2" / "_SUCCESS").unlink()
    assert same(days.read(), counted(scans.filter("id < 10")))
    assert days.add_scans(scans.filter("id >= 10"), 2) and same(days.read(), counted(scans))


def test_nulls_and_empty_registers_have_a_dashboard(spark, tmp_path):
    shape = "id bigint, product_id bigint, overall_status string, compliance_score double, created_at timestamp, scan_date date"
    products = spark.createDataFrame([], "id bigint, name string")
    days = DailyTable(spark, str(tmp_path / "days"))
    days.add_scans(spark.createDataFrame([], shape), 0)
    empty = D.payload(days.read(), spark.createDataFrame([], shape), products, NOW).first()
    assert empty.total_scans == 0 and empty.by_status == [] and empty.recent_failures == [] and len(empty.trend) == K.TREND_DAYS
    assert D.clearance(days.read()).first().clearance is None
    scans = spark.createDataFrame([(None, None, None, None, None, None)] * 2, shape)
    days.add_scans(scans, 1)
    assert same(days.read(), counted(scans)) and D.payload(days.read(), scans, products, NOW).first().total_scans == 2
