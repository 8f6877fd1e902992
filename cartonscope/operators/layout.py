"""Spatial grouping of boxes: words to lines, label/value rows, height measures, calibration.

Grouping keys here may be very uneven (one scan id may hold a large share of all boxes), so no
step gathers all boxes of a scan in one task. Ordered walks over boxes are cut into x-buckets that are
summarised, linked over the summaries, and finished bucket by bucket; those over words stream sorted batches.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from cartonscope import constants as K
from cartonscope.session import ship

ROW_BUCKET_PX = 512
#: Bits that scans are told by in a row search.
SCAN_BITS = 1 << 26


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + n).alias(n) for n in ("x", "y", "width", "height")])


def box_of(c: Column) -> Column:
    return F.struct(*[c[n].alias(n) for n in ("x", "y", "width", "height")])


# ---- words to lines --------------------------------------------------------------------------

LINE_PAIRS = pa.schema([("scan_id", pa.int64()), ("reader", pa.string()), ("y", pa.int32()), ("height", pa.int32()),
                        ("line_no", pa.int32())])
MERGED_WORDS = pa.schema([
    ("scan_id", pa.int64()), ("reader", pa.string()), ("text", pa.string()), ("x", pa.int32()), ("y", pa.int32()),
    ("width", pa.int32()), ("height", pa.int32()), ("confidence", pa.float64()), ("language", pa.string()),
    ("line_no", pa.int32()), ("part_no", pa.int32())])


class LineHeads:
    """First words of the lines opened so far, for words that come by rising y.

    A head takes a word whose distance is within the tolerance of either height. Heads lie by rising y,
    so those that the word's own tolerance reaches begin at a place found by bisection. Those that reach
    the word by their own height begin at the first one not yet passed: a head once out of reach stays so.
    """

    def __init__(self) -> None:
        self.tops: list[int] = []
        self.reach: list[int] = []
        self.passed = 0

    def line_of(self, y: int, height: int) -> int:
        own = math.floor(max(float(K.LINE_MIN_TOLERANCE_PX), height * K.LINE_HEIGHT_RATIO))
        while self.passed < len(self.tops) and y - self.tops[self.passed] > self.reach[self.passed]:
            self.passed += 1
        line = min(self.passed, bisect_left(self.tops, y - own))
        if line == len(self.tops):
            self.tops.append(y)
            self.reach.append(own)
        return line


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _walk_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    photo, heads = None, LineHeads()
    for batch in batches:
        rows = []
        for scan, reader, y, height in zip(*(batch.column(n).to_pylist() for n in ("scan_id", "reader", "y", "height"))):
            if (scan, reader) != photo:
                photo, heads = (scan, reader), LineHeads()
            rows.append((scan, reader, y, height, heads.line_of(y, height)))
        yield _arrow(rows, LINE_PAIRS)


def cluster_lines(words: DataFrame) -> DataFrame:
    """Adds ``line_no``: each word, by y, joins the oldest line whose first word is near enough.

    The decision depends on (y, height) alone and is the same for equal pairs, so the ordered walk
    runs over the distinct pairs of a photo, whose number is bounded by its pixel geometry however
    many words it has; words then pick their line up by an equi-join on (scan, reader, y, height).
    The walk streams sorted Arrow batches and holds the line heads of one photo. Words without a scan,
    reader, y or height are on no line and are left out.
    """
    keys = ["scan_id", "reader"]
    ship(words.sparkSession)
    pairs = words.dropna(subset=[*keys, "y", "height"]).groupBy(*keys, "y", "height").agg(
        F.min("word_idx").alias("word_idx"))
    lines = pairs.repartition(*keys).sortWithinPartitions(*keys, "y", "word_idx", "height").select(*keys, "y", "height").mapInArrow(
        _walk_pairs, from_arrow_schema(LINE_PAIRS))
    return words.join(lines, [*keys, "y", "height"])


def _walk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("scan_id", "reader", "line_no", "x", "y", "width", "height", "text", "confidence", "language")
    line, part, texts = None, 0, []
    left = top = right = bottom = 0
    lowest, language = None, None

    def closed() -> tuple:
        return (line[0], line[1], " ".join(texts), left, top, right - left, bottom - top, lowest, language, line[2], part)
    for batch in batches:
        rows = []
        for scan, reader, no, x, y, width, height, text, confidence, lang in zip(*(batch.column(n).to_pylist() for n in names)):
            same = (scan, reader, no) == line
            if same and x - right <= max(float(K.WORD_MIN_GAP_PX), max(bottom - top, height) * K.WORD_GAP_HEIGHT_RATIO):
                texts.append(text)
                left, top, right, bottom = min(left, x), min(top, y), max(right, x + width), max(bottom, y + height)
                lowest = confidence if lowest is None else lowest if confidence is None else min(lowest, confidence)
                continue
            if line is not None:
                rows.append(closed())
            part = part + 1 if same else 0
            line, texts, left, top, right, bottom = (scan, reader, no), [text], x, y, x + width, y + height
            lowest, language = confidence, lang
        yield _arrow(rows, MERGED_WORDS)
    if line is not None:
        yield _arrow([closed()], MERGED_WORDS)


def merge_words(lines: DataFrame) -> DataFrame:
    """Joins the words of each visual line across small gaps; returns boxes in reading order.

    Lines are spread over tasks, so a photo with very many lines is shared out. The walk streams
    sorted Arrow batches and holds the words of the box it is building, which is the text it writes.
    A null text counts as empty, a null confidence is passed over; words without x or width are left out.
    """
    keys = ["scan_id", "reader", "line_no"]
    ship(lines.sparkSession)
    known = lines.dropna(subset=["x", "width"]).select(
        *keys, "x", "y", "width", "height", F.coalesce("text", F.lit("")).alias("text"), "confidence", "language", "word_idx")
    merged = known.repartition(*keys).sortWithinPartitions(*keys, "x", "y", "word_idx", "width", "height", "text").drop("word_idx").mapInArrow(
        _walk_words, from_arrow_schema(MERGED_WORDS))
    return number_regions(merged)


def number_regions(merged: DataFrame) -> DataFrame:
    """``region_idx`` in (y, x) order. Ranks are taken per horizontal band of a photo and shifted by
    the sizes of the bands above, so a photo with very many boxes is ranked by many tasks."""
    band = F.floor(F.col("y") / ROW_BUCKET_PX).alias("band")
    keys = ["scan_id", "reader"]
    banded = merged.withColumn("band", band)
    sizes = banded.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("band")
                                       .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, "band", above.alias("above"))
    rank = F.row_number().over(Window.partitionBy(*keys, "band").orderBy("y", "x", "line_no", "part_no"))
    return (banded.withColumn("rank_in_band", rank).join(offsets, [*keys, "band"])
            .select(*keys, (F.col("above") + F.col("rank_in_band") - 1).cast("int").alias("region_idx"),
                    "text", "x", "y", "width", "height", "confidence", "language"))


# ---- label/value rows ------------------------------------------------------------------------

def boxes_of(scans: DataFrame, regions: DataFrame) -> DataFrame:
    """Boxes of the scans that rows of ``scans`` name, and of few others: those whose scan's bit is set. The bits are as many
    whatever the input (8 MB), so they are broadcast, in pieces of 256, and boxes that no row search needs are not shuffled for it.
    A join on scan_id must follow."""
    at = F.pmod(F.xxhash64("scan_id"), F.lit(SCAN_BITS))
    # numbers that cannot be null: a null test inferred for them would reach the aggregate that scans and their readers share
    block, place = F.coalesce(F.bitmap_bucket_number("bit"), F.lit(0)), F.coalesce(F.bitmap_bit_position("bit"), F.lit(0))
    blocks = scans.filter("scan_id IS NOT NULL").select(at.alias("bit")).groupBy(block.alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    pieces = blocks.select("block", "bits", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("part")).select(
        (F.col("block") * 128 + F.col("part")).alias("piece"), F.substring("bits", F.col("part") * 32 + 1, F.lit(32)).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("place") % 256 / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (regions.withColumn("bit", at).withColumns({"piece": block * 128 + F.floor(place / 256), "place": place})
            .join(F.broadcast(pieces), "piece").filter(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1).select(regions.columns))


def row_companions(anchors: DataFrame, regions: DataFrame) -> DataFrame:
    """Boxes printed on an anchor's row, to its right, up to the first wide gap.

    ``anchors``: scan_id, anchor_key, a_idx, a_x, a_y, a_width, a_height (few per scan).
    The walk to the first gap is cut into x-buckets: each bucket finds its own first gap, bucket
    summaries (first x, last right edge, whether it has a gap) are linked in x order, and every bucket
    that the walk reaches then keeps its rows before its own gap. ``regions`` of scans with anchors are shuffled by scan
    for the join and by bucket after. A row lies in one array column on purpose: summaries and kept rows then need
    the same columns, so that the join and both shuffles are done once for the two.
    """
    a_h = F.col("a_height")
    centre = F.col("y") + F.col("height") / 2
    band = ((centre >= F.col("a_y") - a_h * K.ROW_BAND_RATIO)
            & (centre <= F.col("a_y") + a_h + a_h * K.ROW_BAND_RATIO))
    candidates = (anchors.filter("a_height > 0").join(boxes_of(anchors, regions), "scan_id")
                  .filter((F.col("region_idx") != F.col("a_idx"))
                          & (F.col("x") >= F.col("a_x") + F.col("a_width")) & band))
    keys = ["scan_id", "anchor_key"]
    fields = [c for c in candidates.columns if c not in keys]
    rows = candidates.select(*keys, F.floor(F.col("x") / ROW_BUCKET_PX).alias("bucket"), "x", "region_idx",
                             (F.col("x") + F.col("width")).alias("right_edge"), F.array(F.struct(*fields)).alias("row"))
    # what the join of kept rows with summaries would infer for one of the two alone
    rows = rows.filter("scan_id IS NOT NULL AND anchor_key IS NOT NULL AND bucket IS NOT NULL").repartition(*keys, "bucket")
    row = F.element_at("row", 1)
    order, max_gap = F.struct("x", "region_idx"), row["a_height"] * K.ROW_GAP_HEIGHT_RATIO
    w = Window.partitionBy(*keys, "bucket").orderBy("x", "region_idx")
    local = rows.withColumn("before", F.lag("right_edge").over(w)).withColumn(
        "gap_here", F.coalesce(F.col("x") - F.col("before") > max_gap, F.lit(False)))
    summary = local.groupBy(*keys, "bucket").agg(
        F.min("x").alias("head_x"), F.max_by("right_edge", order).alias("tail_right"), F.max("gap_here").alias("has_gap"),
        F.first(row["a_x"] + row["a_width"]).alias("a_right"), F.first(max_gap).alias("max_gap"))
    across = Window.partitionBy(*keys).orderBy("bucket")
    linked = (summary
              .withColumn("carry", F.coalesce(F.lag("tail_right").over(across), F.col("a_right")))
              .withColumn("gap_before", F.coalesce(F.col("head_x") - F.col("carry") > F.col("max_gap"), F.lit(False)))
              .withColumn("closed", F.coalesce(F.max(F.col("gap_before") | F.col("has_gap")).over(
                  across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
              .filter(~F.col("closed") & ~F.col("gap_before")).select(*keys, "bucket"))
    before_gap = local.withColumn("past", F.max("gap_here").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("past"))
    return before_gap.join(linked, [*keys, "bucket"]).select(*keys, *[row[c].alias(c) for c in fields])


def row_summary(companions: DataFrame, *match_columns: tuple[str, Column]) -> DataFrame:
    """Per anchor: union box, minimum confidence and text of its companions, and for every named
    match the nearest companion (by centre distance, then x order) where the match is not NULL.

    The gathered text is the row's own printed text, which the result carries whole.
    """
    order = F.struct("x", "region_idx")
    distance = F.abs((F.col("y") + F.col("height") / 2) - (F.col("a_y") + F.col("a_height") / 2))
    part = F.struct("x", "region_idx", "text")
    texts = F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"])
    nearest = [F.min_by(F.struct(m.alias("match"), "text", box().alias("box"), "confidence", "language"),
                        F.when(m.isNotNull(), F.struct(distance.alias("d"), order.alias("o")))).alias(name)
               for name, m in match_columns]
    return companions.groupBy("scan_id", "anchor_key").agg(
        F.first("a_text").alias("anchor_text"), F.array_join(texts, " ").alias("companion_text"),
        F.min("x").alias("c_x"), F.min("y").alias("c_y"),
        F.max(F.col("x") + F.col("width")).alias("c_right"), F.max(F.col("y") + F.col("height")).alias("c_bottom"),
        F.min("confidence").alias("c_confidence"), F.min_by("language", order).alias("c_language"),
        F.count(F.lit(1)).alias("n_companions"), *nearest)


def row_text(anchors: DataFrame, summary: DataFrame) -> DataFrame:
    """Anchor text followed by its companions, in x order; the anchor alone when it has none."""
    return (anchors.join(summary, ["scan_id", "anchor_key"], "left")
            .withColumn("row_text", F.concat_ws(" ", "a_text", "companion_text")))


def row_box(anchors: DataFrame, summary: DataFrame) -> DataFrame:
    """Box around the anchor and its companions, minimum confidence, the anchor's language."""
    j = anchors.join(summary, ["scan_id", "anchor_key"], "left")
    left = F.least("a_x", "c_x")
    top = F.least("a_y", "c_y")
    right = F.greatest(F.col("a_x") + F.col("a_width"), F.col("c_right"))
    bottom = F.greatest(F.col("a_y") + F.col("a_height"), F.col("c_bottom"))
    return j.select("scan_id", "anchor_key", left.alias("x"), top.alias("y"), (right - left).alias("width"),
                    (bottom - top).alias("height"),
                    F.least("a_confidence", "c_confidence").alias("confidence"),
                    F.col("a_language").alias("language"))


# ---- heights and calibration -----------------------------------------------------------------

def text_heights(regions: DataFrame, declarations: DataFrame) -> DataFrame:
    """(scan, key, height) for every box plus price, quantity and brand; long form, so the number
    of boxes per scan is not limited."""
    boxes = regions.select("scan_id", F.concat(F.lit("region_"), F.col("region_idx").cast("string")).alias("key"),
                           F.col("height").cast("double").alias("height"))
    named = [("mrp_value", "mrp_value"), ("net_quantity_value", "net_quantity_value"),
             ("brand", "common_generic_name")]
    fields = F.array(*[F.struct(F.lit(key).alias("key"),
                                F.col(f"{name}.bounding_box.height").cast("double").alias("height"))
                       for key, name in named])
    return boxes.unionByName(declarations.select("scan_id", F.inline(fields)).filter("height IS NOT NULL"))


def ref_height(heights: DataFrame) -> DataFrame:
    return heights.groupBy("scan_id").agg(F.max("height").alias("ref_height"))


def calibrate(scans: DataFrame) -> DataFrame:
    """Adds px_per_mm, pdp_area_cm2, calibration_available and font_size_tier.

    Needs reference_width_mm, reference_height_mm, image_width_px, image_height_px."""
    w, h = F.col("reference_width_mm"), F.col("reference_height_mm")
    known = F.coalesce((w != 0) & (h != 0), F.lit(False))
    return scans.withColumns({
        "px_per_mm": F.when(known, (F.try_divide("image_width_px", w) + F.try_divide("image_height_px", h)) / 2),
        "pdp_area_cm2": F.when(known, w * h / 100.0),
        "calibration_available": known,
        "font_size_tier": F.when(known, "tier2").otherwise("tier1")})
