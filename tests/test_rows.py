"""The row search asks for the boxes that it reads, and joins them with the anchors once."""

from cartonscope.operators import extraction as E
from cartonscope.operators import layout as L
from cartonscope.plans import catalog as C
from cartonscope.plans import label_tables as T
from cartonscope.schemas import REGIONS

DATA = "/root/testdata/sf0.001"


def box(scan, idx, text, x, height=20):
    return (scan, "p", idx, text, x, 10, 50, height, 90.0, "eng")


def test_boxes_are_read_once_for_anchors_and_once_for_rows(spark):
    rows = C.QUERIES["lay_3"](spark, DATA)
    assert rows.collect()
    final = rows._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert sum("FileScan" in line for line in final.splitlines()) == 2


def test_first_boxes_of_some_names_are_those_of_all(spark):
    regions, names = T.label_regions(spark, DATA), ["mrp", "tallest", "any_qty"]
    some = E.first_boxes(regions, names=names).select("scan_id", "n_regions", *[E.at(n, names=names).alias(n) for n in names])
    every = E.first_boxes(regions).select("scan_id", "n_regions", *[E.at(n).alias(n) for n in names])
    assert some.count() and some.exceptAll(every).isEmpty() and every.exceptAll(some).isEmpty()


def test_a_box_without_text_is_no_name_and_one_without_height_leaves_the_tallest_unknown(spark):
    regions = spark.createDataFrame([box(1, 0, None, 0, 90), box(1, 1, "Oats", 0), box(2, 0, "Oats", 0), box(2, 1, "Rice", 0, None)], REGIONS)
    got = {r.scan_id: (r.name, r.tall) for r in E.first_boxes(regions).select(
        "scan_id", E.at("name")["text"].alias("name"), E.at("tallest")["height"].alias("tall")).collect()}
    assert got == {1: ("Oats", 90), 2: ("Rice", None)}


def test_a_row_ends_at_its_first_wide_gap_within_and_between_buckets(spark):
    step = [box(1, i + 1, f"t{i}", 60 + 60 * i) for i in range(20)]  # past x = 512 and 1,024 without a gap
    wide = [box(2, 1, "a", 60), box(2, 2, "b", 400), box(2, 3, "c", 455), box(3, 1, "far", 600), box(4, 1, "a", 60), box(4, 2, "far", 1100)]
    anchors = spark.createDataFrame([(s, "mrp", 0, 0, 10, 50, 20) for s in (1, 2, 3, 4)],
                                    "scan_id bigint, anchor_key string, a_idx int, a_x int, a_y int, a_width int, a_height int")
    kept = L.row_companions(anchors, spark.createDataFrame(step + wide, REGIONS))
    assert {(r.scan_id, r.region_idx) for r in kept.collect()} == {(1, i + 1) for i in range(20)} | {(2, 1), (4, 1)}
