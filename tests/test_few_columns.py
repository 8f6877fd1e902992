"""A query of few columns does not have whole declarations written for it."""

from cartonscope.plans import catalog as C
from cartonscope.plans import label_tables as T

DATA = "/root/testdata/sf0.001//"  # a name that no other test has stored tables of


def test_mrg_4_writes_no_declarations_and_gives_the_same_rows(spark):
    alone = C.QUERIES["mrg_4"](spark, DATA).collect()
    assert not any(T.is_bucketed(spark, DATA, f"declared_{r}") for r in ("p", "s", "v", "ids"))
    stored = C._merged(spark, DATA).select("scan_id", "is_imported", "commodity_category").collect()
    assert alone and sorted(map(str, alone)) == sorted(map(str, stored))
