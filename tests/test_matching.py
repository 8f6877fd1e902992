import random

from pyspark.sql import functions as F

from cartonscope.functions import text as X
from cartonscope.operators import anchors as A


def noisy(rng, terms):
    rows = []
    for i in range(1500):
        t = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(t) + 1)
            t[at:at + rng.randint(0, 1)] = [rng.choice("a .ſKıİक1")] * rng.randint(0, 1)
        body = "".join(t)
        rows.append((i, 0, "".join(rng.choice("ab 1.ક") for _ in range(rng.randint(0, 3))) + rng.choice([body, body.upper(), body + " " + rng.choice(terms)])))
    return rows + [(-1, 0, None), (-2, 0, "")]


def test_one_walk_over_a_text_leaves_no_match_out(spark):
    for extra in ({}, {"more": ["ſmall boxes", "Kilo", "made in x", "rs"], "none": []}):
        d = {**A.compile_dictionary(), **extra}
        terms = [t for ts in d.values() for t in ts]
        texts = spark.createDataFrame(noisy(random.Random(4), terms), "scan_id long, region_idx int, text string")
        groups = [g for g in d if d[g]]
        straight = texts.withColumns({A.LOW: F.expr(A.LOWER.format(c="text")), A.FOLD: F.expr(A.FOLDED.format(c="text"))})
        want = straight.select("scan_id", *[F.expr(A.hit_sql(d[g])).alias(g) for g in groups])
        got = A.with_hits(texts, d).select("scan_id", *[F.col(f"hit_{g}").alias(g) for g in groups])
        assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        tiers = {(r.scan_id, r.grp): r.tier for r in A.anchor_match(texts, d).collect()}
        for r in want.collect():
            assert all(((r.scan_id, g) in tiers) == bool(r[g]) for g in groups)


def test_groups_without_a_part_in_the_text_are_not_tried(spark):
    texts = spark.createDataFrame([(1, 0, "small widget"), (2, 0, "Net Qty 5 g")], "scan_id long, region_idx int, text string")
    d = A.compile_dictionary()
    assert {r.scan_id: set(r[A.MAYBE]) for r in A.with_parts(texts, d).collect()} == {1: set(), 2: {list(d).index("net_qty")}}


def test_no_method_is_generated_that_the_virtual_machine_leaves_uncompiled(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_unit_noise_as_before(spark):
    texts = ["5 mi", "5 MI x", "mid", "5 Mİ", "5 mı", "ml", "", "mi mi", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    from cartonscope.functions import patterns as P
    assert df.filter(~X.fix_unit_noise(F.col("text")).eqNullSafe(F.regexp_replace("text", P.UNIT_MISREAD, "ml"))).count() == 0
