"""Extraction matches the dictionary against each box once, whatever columns its reader asks for."""

from pyspark.sql import functions as F

from cartonscope.operators import extraction as E
from cartonscope.plans import label_tables as T

DATA = "/root/testdata/sf0.001"


def aggregates_run(df) -> int:
    """How often the aggregate of first boxes is computed over the boxes; reused shuffles are not written out again."""
    assert df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    return sum("partial_min_by(region" in line for line in final.splitlines())


def test_readers_of_few_fields_share_one_aggregate(spark):
    declared = E.extract_declarations(T.label_regions(spark, DATA))
    for fields in (["mrp_value.value"], ["net_quantity_value.value", "n_regions"], ["best_before_use_by.found", "image_quality_warning"]):
        asked = declared.select(*[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
        assert aggregates_run(asked.groupBy("f0").count()) == 1, fields
