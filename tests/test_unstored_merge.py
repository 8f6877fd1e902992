"""Readers are merged without storing or moving whole declarations, and give the rows of the stored ones."""

from cartonscope.plans import catalog as C
from cartonscope.plans import label_tables as T

DATA = "/root/testdata/sf0.001///"  # a name that no other test has stored tables of


def test_merges_store_no_declarations_and_give_the_same_rows(spark):
    keys = ("mrg_2", "mrg_3", "mrg_5", "rul_0", "txt_17", "snk_2_header")
    alone = {k: C.QUERIES[k](spark, DATA).collect() for k in keys}
    assert not any(T.is_bucketed(spark, DATA, f"declared_{r}") for r in ("p", "s", "v", "ids"))
    ids = C._ids_few(spark, DATA).collect()
    C._merged(spark, DATA)  # stores what the queries then read
    assert sorted(ids) == sorted(C._declared_ids(spark, DATA).collect())
    for k, rows in alone.items():
        assert rows and sorted(map(str, rows)) == sorted(map(str, C.QUERIES[k](spark, DATA).collect())), k


def test_an_answer_that_cannot_be_used_makes_no_label(spark, monkeypatch):
    answers = T.reader_answers(spark, DATA).limit(5).unionByName(spark.createDataFrame(
        [(10**9, '{"mrp_value": "9"}'), (10**9 + 1, "[1]"), (10**9 + 2, "{broken")], "scan_id bigint, body string"))
    monkeypatch.setattr(T, "reader_answers", lambda *_: answers)
    monkeypatch.setattr(T, "is_bucketed", lambda *_: False)
    merged = C._merged_few(spark, DATA).filter("scan_id >= 1000000000").select("scan_id", "mrp_value.value")
    assert [tuple(r) for r in merged.collect()] == [(10**9, "9")]
