"""What is broadcast follows measured bytes: files that compress well must not fill the driver."""

from pyspark.sql import functions as F

from cartonscope.operators import verification as V
from cartonscope.session import configure

PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    assert rows
    return df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]


def test_stored_results_of_small_files_are_not_broadcast(spark, tmp_path):
    """700,000 rows of KEY and status that Parquet keeps in less than the limit."""
    before = spark.conf.get(PLANNED), spark.conf.get(MEASURED, None)
    try:
        spark.conf.unset(MEASURED)
        spark.conf.set(PLANNED, str(10 << 20))
        configure(spark)
        spark.range(700_000).select(F.floor(F.col("id") / 14).alias("scan_id"), F.concat(F.lit("R"), F.col("id") % 14).alias("rule_id"),
                                    F.lit("NEEDS_VERIFICATION").alias("status")).write.parquet(str(tmp_path / "results"))
        spark.range(50_000).write.parquet(str(tmp_path / "scans"))
        results, scans = spark.read.parquet(str(tmp_path / "results")), spark.read.parquet(str(tmp_path / "scans"))
        assert sum(f.stat().st_size for f in (tmp_path / "results").glob("*.parquet")) < 10 << 20
        requests = spark.range(400_000).select(F.col("id").alias("request_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 50_000).alias("scan_id"),
                                               F.concat(F.lit("R"), F.col("id") % 14).alias("rule_id"), F.lit("admin").alias("role"))
        done = V.classify_requests(requests, scans, results).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
        plan = executed(done)
        big = [line for line in plan.splitlines() if "Join" in line and "rule_id" in line]
        assert big and all("SortMergeJoin" in line for line in big), plan
    finally:
        spark.conf.set(PLANNED, before[0])
        spark.conf.unset(MEASURED) if before[1] is None else spark.conf.set(MEASURED, before[1])


def test_the_limit_of_the_session_is_kept_for_measured_bytes(spark):
    before = spark.conf.get(PLANNED), spark.conf.get(MEASURED, None)
    try:
        spark.conf.unset(MEASURED)
        spark.conf.set(PLANNED, "3000000")
        configure(configure(spark))
        assert spark.conf.get(PLANNED) == "-1" and spark.conf.get(MEASURED) == "3000000"
        spark.conf.unset(MEASURED)
        configure(spark)
        assert spark.conf.get(MEASURED, None) is None  # a session without broadcasts stays without
    finally:
        spark.conf.set(PLANNED, before[0])
        spark.conf.unset(MEASURED) if before[1] is None else spark.conf.set(MEASURED, before[1])
