"""Labels with known verdicts and known awkward readings, all in two Spark plans."""

import pytest
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.operators import extraction as E
from cartonscope.operators import rollups as R
from cartonscope.operators import rules as RU
from cartonscope.plans import label_pipeline as PL
from cartonscope.schemas import REGIONS

META = ("scan_id bigint, commodity_category string, is_imported boolean, is_perishable_category boolean, "
        "is_medical_device boolean, is_combination_or_multipiece_package boolean, reference_width_mm double, "
        "reference_height_mm double, image_width_px int, image_height_px int")
OK = dict.fromkeys(["R6-1", "R6-3", "R6-4", "R6-5", "R6-7", "R6-9", "R8-1", "R8-2"], "PASS")
GOLDEN = [
    ("solid", False, OK, [
        ("Hill Oats", 70, 30, 360, 54), ("Contents 450 g", 70, 120, 190, 24),
        ("Retail Price Rs. 135 inclusive of all taxes", 70, 175, 400, 24), ("Packed on 11/2025", 70, 230, 210, 24),
        ("Marketed by Hill Grain Works, Canal Street, Indore 452001", 70, 285, 480, 24),
        ("Helpline 1800-207-3141, ask@hillgrain.example.net, Indore 452001", 70, 340, 500, 24)]),
    ("liquid", False, {"R6-4": "FAIL", "R8-2": "PASS"}, [
        ("Packed by Blue Spring, Nashik 422001", 35, 30, 360, 24), ("Spring Soda", 35, 90, 300, 56),
        ("Contents: 6 pcs", 35, 190, 190, 24), ("Retail Price Rs. 96 including all taxes", 35, 250, 360, 24),
        ("Packing date 02/2026", 35, 310, 230, 24), ("Toll free 1800-209-6655", 35, 370, 260, 24)]),
    ("solid", True, {**{r: "PASS" for r in ("R6-1", "R6-3", "R6-4", "R6-5", "R6-7", "R8-2")}, "R6-2": "FAIL",
                     "R6-9": "NEEDS_VERIFICATION"}, [
        ("ग्राहक सेवा: 1800-208-7711", 60, 30, 300, 28), ("Fjord Crackers", 60, 95, 340, 56),
        ("શુદ્ધ Net Quantity १७५ g", 60, 190, 280, 28), ("અં. કિંમત રૂ. 310 તમામ કરવેરા સહિત", 60, 255, 420, 28),
        ("पैकिंग तिथि 04/2026", 60, 320, 240, 28), ("द्वारा पैक फियर्ड ट्रेडिंग, कोच्चि 682001", 60, 385, 440, 28)]),
    ("solid", False, {"R6-1": "PASS", "R6-7": "PASS", "R8-1": "FAIL"}, [
        ("Bright Wash", 40, 25, 320, 50), ("Net Weight 750 g", 40, 110, 200, 22), ("Packed on 06/2026", 40, 165, 200, 22),
        ("Packed by Bright Home, Surat 395007", 40, 220, 360, 22),
        ("Helpline 1800-205-1212, ask@brighthome.example.net", 40, 275, 470, 22),
        ("Retail Price Rs. 188 inclusive of all taxes", 1300, 1010, 380, 22)]),
]
READINGS = [
    ([("Markoted by Lark Foods", 5, 5, 240, 24)], {"manufacturer_name": "Markoted by Lark Foods"}),
    ([("22+19 people asked (survey, 2021)", 5, 5, 300, 24)], {"mrp_value": None}),
    ([("ooll730l", 5, 5, 90, 24)], {"net_quantity_value": None}),
    ([("Lic. No. 2004415000377", 5, 5, 260, 24)], {"consumer_care_phone": None}),
    ([("ic No. 2004415000377", 5, 5, 260, 24)], {"consumer_care_phone": None}),
    ([("2004415000377", 5, 5, 200, 24), ("1800 205 7788", 5, 60, 200, 24)], {"consumer_care_phone": "1800 205 7788"}),
    ([("650 mi", 5, 5, 90, 24)], {"net_quantity_value": "650", "net_quantity_unit": "ml"}),
    ([("CONTENTS: 85 g", 5, 5, 190, 24)], {"net_quantity_value": "85", "net_quantity_unit": "g"}),
    ([("CONTENTS: +85", 5, 5, 190, 24)], {"net_quantity_value": None}),
    ([("Net Weight ३६० g", 5, 5, 200, 24)], {"net_quantity_value": "360"}),
    ([("MRP Rs. ૪૭ including all taxes", 5, 5, 330, 24)], {"mrp_value": "47", "mrp_inclusive_of_taxes_stated": "yes"}),
    ([("INET QTY", 400, 900, 230, 70), ("38", 850, 880, 80, 60), ("g", 950, 890, 40, 60)],
     {"net_quantity_value": "38", "net_quantity_unit": "g"}),
    ([("PKD", 410, 1200, 120, 66), ("9/04/26", 900, 1190, 180, 44), ("EXPIRY", 405, 1330, 200, 80),
      ("19/11/26", 890, 1300, 220, 52)], {"mfg_month_year": "9/04/26", "best_before_use_by": "19/11/26"}),
    ([("NET QTY", 90, 700, 240, 70), ("640 kg", 2900, 700, 190, 60)], {"net_quantity_value": None}),
    ([("EXPIRY. 19/11/26", 5, 5, 200, 24)], {"best_before_use_by": "19/11/26"}),
]


def regions_of(spark, labels):
    rows = [(i, "p", n, t, x, y, w, h, 92.0, "eng") for i, boxes in enumerate(labels)
            for n, (t, x, y, w, h) in enumerate(boxes)]
    return spark.createDataFrame(rows, REGIONS)


@pytest.fixture(scope="module")
def golden(spark):
    regions = regions_of(spark, [g[3] for g in GOLDEN])
    meta = spark.createDataFrame(
        [(i, g[0], g[1], False, None, None, None, None, max([460] + [b[1] + b[3] + 20 for b in g[3]]),
          max([260] + [b[2] + b[4] + 20 for b in g[3]])) for i, g in enumerate(GOLDEN)], META)
    return PL.results_of(PL.declarations_of(regions, meta), regions).cache()


def test_golden_verdicts(golden):
    got = {(r.scan_id, r.rule_id): r.status for r in golden.select("scan_id", "rule_id", "status").collect()}
    assert len(got) == len(GOLDEN) * len(K.RULES)
    wrong = {(i, rule): got[i, rule] for i, g in enumerate(GOLDEN) for rule, want in g[2].items() if got[i, rule] != want}
    assert not wrong


def test_compliant_label_has_no_failure_and_notes_name_the_outlier(golden):
    assert golden.filter("scan_id = 0 AND status = 'FAIL'").count() == 0
    note = golden.filter("scan_id = 3 AND rule_id = 'R8-1'").first().notes
    assert "'MRP'" in note and "proxy" in note


def test_boxes_of_undecided_results_are_not_drawn(golden):
    drawn = R.evidence_boxes(golden).collect()
    assert drawn and not any("NEEDS_VERIFICATION" in r.label for r in drawn)


def test_awkward_readings(spark):
    got = {r.scan_id: r for r in E.extract_declarations(regions_of(spark, [b for b, _ in READINGS])).collect()}
    wrong = [(i, f, got[i][f].value) for i, (_, want) in enumerate(READINGS) for f, v in want.items() if got[i][f].value != v]
    assert not wrong


def test_user_rule_is_counted(spark, golden):
    assert RU.default_registry().register("X", lambda row: [RU.Case(None, K.PASS)]).rule_ids[-1] == "X"
    assert golden.agg(F.countDistinct("rule_id")).first()[0] == 14
