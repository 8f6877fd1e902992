"""Stored results are written, changed and compacted without a shuffle of their rows."""

import glob

from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.operators import verification as V
from cartonscope.plans import catalog as C
from cartonscope.sources.results_table import ResultsTable
from tests.test_verification import accepted, open_keys, results, same


def exchanges(df) -> int:
    assert df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_changes_meet_rows_in_the_task_that_reads_them(spark, tmp_path):
    base, keys = results(spark, 300).repartition(3), open_keys(spark, 300)
    table = ResultsTable(spark, str(tmp_path / "t"), 8).create(base)
    table.apply(accepted(spark, keys[:90]), 1)
    table.apply(accepted(spark, keys[80:120], "again"), 2)
    now = table.read()
    assert exchanges(now) == 0 and now.rdd.getNumPartitions() == 8
    want = V.apply_verifications(V.apply_verifications(base, accepted(spark, keys[:90])), accepted(spark, keys[90:120], "again"))
    assert same(now.drop("bucket"), want)


def test_rows_are_not_dealt_anew(spark, tmp_path, monkeypatch):
    base, keys = results(spark, 300).repartition(3), open_keys(spark, 300)
    rows, requests = base.cache(), accepted(spark, keys[:50])

    def moved(*_):
        raise AssertionError("rows are shuffled")
    monkeypatch.setattr(type(base), "repartition", moved)
    table = ResultsTable(spark, str(tmp_path / "t"), 8).create(rows)
    assert len(glob.glob(f"{tmp_path}/t/rows/bucket=*/gen=0/part-*")) == 8 and not glob.glob(f"{tmp_path}/t/staged-*")
    table.apply(requests, 1)
    assert table.compact() and same(table.read().drop("bucket"), V.apply_verifications(rows, requests))
    assert table.read().filter(F.col("status") == K.PASS).count() == rows.filter(F.col("status") == K.PASS).count() + 50


def test_the_audit_log_reads_the_accepted_requests_once(spark, monkeypatch):
    calls, real = [], C._classified
    monkeypatch.setattr(C, "_classified", lambda *a: calls.append(1) or real(*a))
    before = len(calls)
    assert C.QUERIES["snk_3"](spark, "/root/testdata/sf0.001////").count() and len(calls) == before + 1
    assert C.QUERIES["snk_3"](spark, "/root/testdata/sf0.001////").count() and len(calls) == before + 1
