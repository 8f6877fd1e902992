"""Words to lines to boxes, against plain walks over all heads and all words."""

import random
import time

from pyspark.sql import functions as F

from cartonscope.operators import layout as L


def plain_lines(words):
    """word_idx -> line, trying every head in turn."""
    heads, line = [], {}
    for y, i, h in sorted(words):
        taken = next((n for n, (hy, hh) in enumerate(heads) if abs(y - hy) <= max(8, 0.4 * max(h, hh))), len(heads))
        if taken == len(heads):
            heads.append((y, h))
        line[i] = taken
    return line


def plain_boxes(words):
    """[text, x, y, right, bottom, confidence] of one line's words (x, y, idx, width, height, text, confidence)."""
    out = []
    for x, y, _, w, h, text, c in sorted(words):
        box = out[-1] if out else None
        if box and x - box[3] <= max(40, 2.5 * max(box[4] - box[2], h)):
            out[-1] = [f"{box[0]} {text}", min(box[1], x), min(box[2], y), max(box[3], x + w), max(box[4], y + h), min(box[5], c)]
        else:
            out.append([text, x, y, x + w, y + h, c])
    return out


def test_heads_found_by_bisection_are_those_of_a_full_search():
    rng = random.Random(5)
    for _ in range(300):
        words = [(rng.randint(0, rng.choice([40, 400])), i, rng.choice([0, 1, 20, 21, 25, rng.randint(2, 120)])) for i in range(60)]
        heads, got = L.LineHeads(), {}
        for y, i, h in sorted(words):
            got[i] = heads.line_of(y, h)
        assert got == plain_lines(words)


def test_time_a_word_stays_flat_from_a_thousand_to_a_million_words_of_one_photo():
    def cost(n):
        words = [(3 * k, 1 + k * 7919 % 90) for k in range(n)]
        heads, start = L.LineHeads(), time.perf_counter()
        for y, h in words:
            heads.line_of(y, h)
        return (time.perf_counter() - start) / n
    assert cost(1_000_000) < 5 * min(cost(1_000) for _ in range(5))


def test_boxes_equal_a_plain_walk_also_across_arrow_batches(spark):
    rng = random.Random(8)
    words = [(s, "p", i, rng.randint(0, 3000), rng.randint(0, 150), rng.randint(0, 90), rng.randint(0, 30), f"w{i}", float(rng.randint(0, 99)))
             for s in range(6) for i in range(3 if s else 400)]
    words += words[:4]  # repeated rows stay words of their own
    df = spark.createDataFrame(words, "scan_id bigint, reader string, word_idx int, x int, y int, width int, height int, text string, "
                                      "confidence double").withColumns({"language": F.lit("eng"), "seen": F.lit(1)})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {}
        for r in L.merge_words(L.cluster_lines(df)).collect():
            got.setdefault(r.scan_id, []).append((r.region_idx, [r.text, r.x, r.y, r.x + r.width, r.y + r.height, r.confidence]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for s in range(6):
        mine = [w for w in words if w[0] == s]
        line = plain_lines({(w[4], w[2], w[6]) for w in mine})
        lines = {n: [(w[3], w[4], w[2], w[5], w[6], w[7], w[8]) for w in mine if line[w[2]] == n] for n in set(line.values())}
        want = [(b[2], b[1], n, k, b) for n, ws in lines.items() for k, b in enumerate(plain_boxes(ws))]
        assert [b for _, b in sorted(got[s])] == [b for *_, b in sorted(want)]
        assert sorted(i for i, _ in got[s]) == list(range(len(want)))


def test_words_with_nulls_empty_tables_and_long_lines(spark):
    shape = ("scan_id bigint, reader string, word_idx int, x int, y int, width int, height int, text string, confidence double, "
             "language string")
    rows = [(1, "p", 0, 0, 0, 10, 10, None, None, None), (1, "p", 1, 12, 0, 10, 10, "b", 7.0, "eng"),
            (1, "p", 2, None, 0, 10, 10, "lost", 1.0, "eng"), (1, "p", 3, 30, None, 10, 10, "lost", 1.0, "eng"),
            (None, "p", 4, 0, 0, 10, 10, "lost", 1.0, "eng")]
    got = L.merge_words(L.cluster_lines(spark.createDataFrame(rows, shape))).collect()
    assert [(r.text, r.x, r.width, r.confidence, r.language) for r in got] == [(" b", 0, 22, 7.0, None)]
    assert L.merge_words(L.cluster_lines(spark.createDataFrame([], shape))).count() == 0
    long = spark.range(50_000).selectExpr("1L scan_id", "'p' reader", "cast(id as int) word_idx", "cast(id * 12 as int) x", "0 y",
                                          "10 width", "10 height", "'w' text", "1.0d confidence", "'eng' language")
    boxes = L.merge_words(L.cluster_lines(long)).collect()
    assert len(boxes) == 1 and len(boxes[0].text) == 99_999 and boxes[0].width == 599_998
