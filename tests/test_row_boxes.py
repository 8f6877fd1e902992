"""A row search is given the boxes of scans with anchors, all of them, and few others."""

from pyspark.sql import functions as F

from cartonscope import session
from cartonscope.operators import extraction as E
from cartonscope.operators import layout as L
from cartonscope.plans import label_tables as T

DATA = "/root/testdata/sf0.001"


def test_no_box_of_a_wanted_scan_is_lost(spark):
    boxes = spark.range(40_000).select((F.col("id") % 20_000 - 10_000).alias("scan_id"), F.col("id").alias("region_idx"))
    boxes = boxes.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS scan_id, 0L AS region_idx"))
    wanted = boxes.filter("scan_id % 7 = 3").select("scan_id").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS scan_id"))
    kept = L.boxes_of(wanted, boxes)
    assert kept.columns == boxes.columns
    want = boxes.filter("scan_id % 7 = 3").count()
    assert kept.filter("scan_id % 7 = 3").count() == want and kept.count() < want * 1.05
    assert L.boxes_of(wanted.limit(0), boxes).count() == 0


def test_boxes_of_scans_without_anchors_are_not_joined(spark, monkeypatch):
    regions, asked = T.label_regions(spark, DATA), []
    real = L.boxes_of
    monkeypatch.setattr(L, "boxes_of", lambda *a: asked.append(real(*a)) or asked[-1])
    names = list(E.ROW_FIELDS)
    anchors = E.row_anchors(E.first_boxes(regions, names=names), names=names)
    assert L.row_companions(anchors, regions).count()
    given = asked[0].count()
    assert given < regions.count() / 2 and given >= regions.join(anchors, "scan_id", "left_semi").count()


def test_splits_are_small_for_packed_boxes(spark, tmp_path):
    session.configure(spark)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m" and T.ROW_GROUP == 16 << 20
