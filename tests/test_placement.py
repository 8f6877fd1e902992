"""Clear space of the quantity: every box of a scan against a plain check, and a plan that is only built."""

import random

from pyspark.sql import functions as F

from cartonscope import schemas as S
from cartonscope.operators import rules as RU

DECLARED = f"scan_id long, net_quantity_value {S.EXTRACTED.simpleString()}, kept string"
BOXES = "scan_id long, region_idx int, text string, x int, y int, width int, height int"


def declared(spark, boxes):
    """One row a scan: the box of its quantity, None for no box, "lost" for none found."""
    rows = [(s, None if b == "lost" else ("5 g", None, b, None, None, True, "ocr", None), f"row {s}") for s, b in boxes.items()]
    rows = [(s, v if v is not None else (None, None, (0, 0, 9, 9), None, None, False, "ocr", None), k) for s, v, k in rows]
    return spark.createDataFrame(rows, DECLARED)


def plain(box, found):
    if box is None or box == "lost" or box[3] <= 0:
        return None
    x, y, w, h = box
    out = []
    for idx, text, bx, by, bw, bh in sorted(found, key=lambda r: r[0]):
        within = bx >= x and by >= y and bx + bw <= x + w and by + bh <= y + h
        apart = bx + bw <= x - 2 * h or bx >= x + w + 2 * h or by + bh <= y - h or by >= y + h + h
        if not within and not apart:
            out.append(f'"{text}"' if "'" in text else f"'{text}'")
    return ", ".join(out[:3]) if out else None


def test_intruders_equal_a_plain_check(spark):
    rng = random.Random(4)
    quantity = {s: rng.choice([None, "lost", (60, 60, 30, 0)]) if s % 6 == 0 else (rng.randrange(40, 80), rng.randrange(40, 80), rng.randrange(5, 40), rng.randrange(1, 15))
                for s in range(60)}
    boxes = {s: [(i, rng.choice(["a", "it's", "b c"]) + str(i), rng.randrange(0, 150), rng.randrange(0, 150), rng.randrange(0, 30), rng.randrange(0, 20))
                 for i in range(rng.choice([0, 1, 5, 40]))] for s in quantity}
    for s, b in list(quantity.items())[1:20:3]:
        if isinstance(b, tuple):  # boxes whose edges only touch, one inside, one equal
            x, y, w, h = b
            boxes[s] += [(100, "left", x - 2 * h - 5, y, 5, h), (101, "above", x, y - h - 3, w, 3), (102, "in", x, y, max(0, w - 1), h), (103, "same", x, y, w, h),
                         (104, "near", x - 2 * h - 5, y, 6, h)]
    regions = spark.createDataFrame([(s, *b) for s, found in boxes.items() for b in found] + [(999, 0, "stray", 1, 1, 1, 1)], BOXES)
    got = RU.with_clear_space(declared(spark, quantity), regions).collect()
    assert sorted(r.scan_id for r in got) == sorted(quantity)
    assert {r.scan_id: r.intruding for r in got} == {s: plain(b, boxes[s]) for s, b in quantity.items()}
    assert all(r.kept == f"row {r.scan_id}" for r in got) and sum(r.intruding is not None for r in got) > 10


def test_one_scan_with_very_many_intruders(spark):
    regions = spark.range(60_000).select(F.lit(1).cast("long").alias("scan_id"), (60_000 - F.col("id")).cast("int").alias("region_idx"),
                                         F.concat(F.lit("t"), (60_000 - F.col("id")).cast("string")).alias("text"),
                                         *[F.lit(v).alias(c) for c, v in (("x", 50), ("y", 50), ("width", 100), ("height", 5))])
    got = RU.with_clear_space(declared(spark, {1: (55, 51, 10, 5), 2: (1, 1, 2, 2)}), regions).collect()
    assert {r.scan_id: r.intruding for r in got} == {1: "'t1', 't2', 't3'", 2: None}


def test_building_the_rules_starts_no_job(spark):
    from cartonscope.plans import label_pipeline as PL
    regions = spark.createDataFrame([], S.REGIONS)
    meta = spark.createDataFrame([], "scan_id bigint, commodity_category string, is_imported boolean, is_perishable_category boolean, is_medical_device boolean, "
                                     "is_combination_or_multipiece_package boolean, reference_width_mm double, reference_height_mm double, image_width_px int, image_height_px int")
    sc = spark.sparkContext
    sc.setJobGroup("building", "no job may carry this name")
    try:
        results = PL.results_of(PL.declarations_of(regions, meta), regions)
    finally:
        sc._jsc.sc().clearJobGroup()
    assert len(sc.statusTracker().getJobIdsForGroup("building")) == 0
    assert results.count() == 0
