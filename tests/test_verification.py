"""The stored results: what a load of verifications reads and writes, and that no step may be lost or doubled."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope import schemas as S
from cartonscope.operators import anchors as A
from cartonscope.operators import rollups as R
from cartonscope.operators import verification as V
from cartonscope.sources.results_table import ResultsTable

SCHEMA = "scan_id bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.RULE_RESULT.fields)
RULES = list(K.RULES)[:4]


def results(spark, scans):
    status = [K.NEEDS_VERIFICATION, K.PASS, K.FAIL, K.NEEDS_VERIFICATION]
    rows = [(s, n, r, "ref", "text", status[(s + n) % 4], None, f"note {n}" if s % 2 else None, None, None, None, None) for s in range(scans) for n, r in enumerate(RULES)]
    return spark.createDataFrame(rows, SCHEMA)


def accepted(spark, keys, note="seen"):
    return spark.createDataFrame([(s, r, note) for s, r in keys], "scan_id bigint, rule_id string, note string").select(
        "scan_id", "rule_id", F.timestamp_seconds(F.lit(1_000_000_000) + F.col("scan_id")).alias("ts"), F.lit("who@x").alias("email"), "note")


def open_keys(spark, scans):
    return [(r.scan_id, r.rule_id) for r in results(spark, scans).filter("status = 'NEEDS_VERIFICATION'").orderBy("scan_id", "rule_id").collect()]


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def files(path):
    return {f: os.path.getsize(f) for f in glob.glob(f"{path}/**/part-*", recursive=True)}


def test_table_equals_results_in_place(spark, tmp_path):
    base, keys = results(spark, 60), open_keys(spark, 60)
    table = ResultsTable(spark, str(tmp_path / "t"), 8).create(base)
    assert same(table.read().drop("bucket"), base)
    done = V.apply_verifications(base, accepted(spark, keys[:7]))
    assert table.apply(accepted(spark, keys[:7]), 1) == table.buckets_of(accepted(spark, keys[:7]))
    assert same(table.read().drop("bucket"), done)
    # the same load again, as after a failure
    table.apply(accepted(spark, keys[:7]), 1)
    assert same(table.read().drop("bucket"), done)
    # a later load leaves what is decided by now
    done = V.apply_verifications(done, accepted(spark, keys[20:22], "again"))
    table.apply(accepted(spark, keys[5:7] + keys[20:22], "again"), 2)
    assert same(table.read().drop("bucket"), done)
    due = table.compact()
    assert due and same(table.read().drop("bucket"), done) and table.compact() == []
    table.apply(accepted(spark, keys[:7] + keys[30:31]), 1)
    assert same(table.read().drop("bucket"), V.apply_verifications(done, accepted(spark, keys[30:31])))
    table.compact()
    assert same(table.read().drop("bucket"), V.apply_verifications(done, accepted(spark, keys[30:31])))


def test_compaction_that_stops_halfway_changes_nothing(spark, tmp_path, monkeypatch):
    from cartonscope.sources import results_table as RT
    base, keys = results(spark, 40), open_keys(spark, 40)
    table = ResultsTable(spark, str(tmp_path / "t"), 4).create(base)
    table.apply(accepted(spark, keys[:5]), 1)
    want = V.apply_verifications(base, accepted(spark, keys[:5]))

    def fails(*_):
        raise RuntimeError("stopped")
    monkeypatch.setattr(RT, "_remove", fails)
    with pytest.raises(RuntimeError):
        table.compact()
    monkeypatch.undo()
    assert same(table.read().drop("bucket"), want)
    table.compact()
    assert same(table.read().drop("bucket"), want) and table._versions("changes", "load") == []


@pytest.mark.parametrize("scans", [200, 2_000])
def test_bytes_written_follow_the_load(spark, tmp_path, scans):
    path = str(tmp_path / "t")
    table = ResultsTable(spark, path, 32).create(results(spark, scans))
    before, keys = files(path), open_keys(spark, 200)[:3]
    assert len(before) == 32
    touched = table.apply(accepted(spark, keys), 1)
    added = {f: n for f, n in files(path).items() if f not in before}
    assert len(touched) <= 3 and len(added) == len(touched) and all("/changes/bucket=" in f for f in added)
    # three rows, whatever the table holds
    assert spark.read.parquet(f"{path}/changes").count() == 3 and sum(added.values()) < 4 * 6_500
    table.compact()
    after = files(path)
    assert {f for f in before if f not in after} == {f for f in before if any(f"bucket={b}/" in f for b in touched)}


def test_only_the_buckets_asked_for_are_opened(spark, tmp_path):
    table = ResultsTable(spark, str(tmp_path / "t"), 16).create(results(spark, 100))
    near = table.near(accepted(spark, [(5, RULES[0])]))
    assert near.select(F.col("_metadata.file_path")).distinct().count() == 1
    scan = near._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"DataFilters: \[\].*PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", scan)
    assert near.filter("scan_id = 5").count() == len(RULES)


def test_replay_from_the_audit_gives_the_applied_table(spark, tmp_path):
    base, keys = results(spark, 30), open_keys(spark, 30)
    table = ResultsTable(spark, str(tmp_path / "t"), 4).create(base)
    done = accepted(spark, keys[:6], None)
    table.apply(done, 1)
    audit = V.audit_rows(done)
    assert same(V.replay(base, audit), table.read().drop("bucket"))


def test_requests_are_answered_in_order(spark):
    scans = spark.range(3)
    requests = spark.createDataFrame([
        (1, 5, 0, RULES[0], "admin"), (2, 4, 0, RULES[0], "admin"), (3, 1, 0, RULES[0], "inspector"), (4, 1, 9, RULES[0], "admin"),
        (5, 1, 0, "R0", "admin"), (6, 1, 0, RULES[1], "admin"), (7, 4, 0, RULES[0], "admin")],
        "request_id long, at long, scan_id long, rule_id string, role string").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.request_id: r.code for r in V.classify_requests(requests, scans, results(spark, 3)).collect()}
    assert got == {1: 409, 2: 200, 3: 403, 4: 404, 5: 404, 6: 409, 7: 409}


def test_sixteen_rules_round_halves_to_even(spark):
    """1/16 is 6.25 % and shows as 6.2; 3/16 is 18.75 % and shows as 18.8."""
    rows = [(scan, n, K.PASS if n < scan else K.FAIL) for scan in (0, 1, 3, 16) for n in range(16)] + [(99, 0, K.NOT_APPLICABLE)]
    found = R.compliance_score(spark.createDataFrame(rows, "scan_id long, rule_no int, status string")).collect()
    assert {r.scan_id: r.compliance_score for r in found} == {0: 0.0, 1: 6.2, 3: 18.8, 16: 100.0, 99: None} == {
        **{s: round(100 * s / 16, 1) for s in (0, 1, 3, 16)}, 99: None}


def test_terms_may_hold_both_kinds_of_quotes(spark):
    terms = spark.createDataFrame([("mrp", "eng", "max 'retail\" price"), ("mrp", "eng", "it's")], "grp string, lang string, term string")
    boxes = spark.createDataFrame([(1, 0, "Max 'Retail\" Price 5"), (1, 1, "max retail price"), (2, 0, "it's 5")], "scan_id long, region_idx int, text string")
    found = A.anchor_match(boxes, A.compile_dictionary(terms)).select("scan_id", "region_idx", "grp").distinct().collect()
    assert {(1, 0, "mrp"), (2, 0, "mrp")} <= {tuple(r) for r in found}
    assert spark.sql(f"SELECT {A.quoted('a\\b')} AS a, {A.quoted('it\'s')} AS b").first() == ("a\\b", "it's")
