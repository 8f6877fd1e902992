"""Label, register, arrival and image tables derived from the order/part/event tables.

These give every operator whole-table inputs whose size follows the source tables. Only integer
arithmetic, string slots and date formatting are used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.plans import label_templates as L
from cartonscope.session import shared_folder
from cartonscope.sources.bucketed import write_bucketed

RULE_IDS = list(K.RULES)
#: Bytes of a row group of a derived table, so that a split of the size that session.configure sets holds whole ones.
ROW_GROUP = 16 << 20
_WRITTEN: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared one."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table as it would lie in storage: written once per session, then read like any
    other table, so queries start from a scan and not from the derivation."""
    return spark.read.parquet(written_as(spark, sf_dir, name, lambda path: build().write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)))


_BUCKETED: dict[tuple[str, str, str], tuple[DataFrame, str]] = {}
_BUCKETS: dict[str, int] = {}


def bucketed(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """A derived table with one row per scan, stored by bucket of scan once per session, and its folder; all have as many buckets as the first."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUCKETED:
        buckets, path = _BUCKETS.setdefault(key[0], int(spark.conf.get("spark.sql.shuffle.partitions"))), f"{scratch(spark)}/{name}"
        _BUCKETED[key] = write_bucketed(build(), path, buckets), path
    return _BUCKETED[key]


def is_bucketed(spark: SparkSession, sf_dir: str, *names: str) -> bool:
    """Whether these tables are stored already in this session."""
    return all((spark.sparkContext.applicationId, sf_dir, name) in _BUCKETED for name in names)


def written_as(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], object]) -> str:
    """The folder of what write(folder) has written, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{scratch(spark)}/{name}"
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _padded(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def label_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "label_base", lambda: derive_base(spark, sf_dir))


def derive_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: the slot values of its label."""
    first = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.min("l_partkey").alias("p_partkey"), F.min("l_suppkey").alias("s_suppkey")))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = (orders.join(first, "o_orderkey", "left").join(part, "p_partkey", "left")
              .join(supplier.join(F.broadcast(nation), "s_nationkey", "left"), "s_suppkey", "left"))
    scan = F.col("o_orderkey")
    # rows are few and small here but each becomes several boxes: spread them before that
    joined = joined.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey", "o_orderdate")
    paise = F.coalesce(F.round(F.col("p_retailprice") * 100).cast("bigint"), F.lit(9950).cast("bigint"))
    return joined.select(
        scan.alias("scan_id"), (scan % L.CASES).cast("int").alias("case_no"),
        F.coalesce("p_name", F.lit("plain carton")).alias("name"),
        F.coalesce(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit("Unlisted Maker")).alias("maker"),
        F.coalesce(F.replace("n_name", F.lit("_"), F.lit(" ")), F.lit("NATION X")).alias("nation"),
        (F.coalesce("p_size", F.lit(9)) * 5).cast("string").alias("qty"),
        F.concat(F.floor(paise / 100).cast("string"), F.lit("."),
                 _padded(paise % 100, 2)).alias("price"),
        F.date_format("o_orderdate", "MM/yyyy").alias("month"),
        F.date_format("o_orderdate", "dd/MM/yy").alias("date"),
        F.concat(F.lit("1800-"), _padded(scan % 1000, 3), F.lit("-"), _padded(scan % 10000, 4)).alias("phone"),
        _padded(scan % 100000, 5).alias("digits5"))


SLOTS = ["name", "maker", "nation", "qty", "price", "month", "date", "phone", "digits5"]


def label_regions(spark: SparkSession, sf_dir: str, reader: str = "p") -> DataFrame:
    primary = written(spark, sf_dir, "regions_p", lambda: derive_regions(spark, sf_dir))
    if reader == "p":
        return primary
    return written(spark, sf_dir, "regions_s", lambda: second_reading(primary))


def derive_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes of one reader. The template is a fixed table of under 200 rows."""
    template = spark.createDataFrame(
        L.TEMPLATE, "case_no int, region_idx int, text string, x int, y int, width int, height int")
    joined = label_base(spark, sf_dir).join(F.broadcast(template), "case_no")
    scan, idx = F.col("scan_id"), F.col("region_idx")
    text = F.col("text")
    for slot in SLOTS:
        text = F.replace(text, F.lit("{" + slot + "}"), F.col(slot))
    confidence = F.when(F.col("case_no") < 12, F.lit(92.0)).otherwise(
        (40 + (scan * 17 + idx * 13) % 60).cast("double"))
    return joined.select(
        scan, F.lit("p").alias("reader"), idx, text.alias("text"),
        (F.col("x") + scan % 7).cast("int").alias("x"), (F.col("y") + scan % 5).cast("int").alias("y"),
        "width", "height", confidence.alias("confidence"), F.lit("eng").alias("language"))


def second_reading(regions: DataFrame) -> DataFrame:
    """What a second pass over the same photo reads: some boxes lost, some text altered."""
    scan, idx, text = F.col("scan_id"), F.col("region_idx"), F.col("text")
    altered = (F.when((scan + idx) % 7 == 1, F.replace(text, F.lit(" Rs. "), F.lit(" Rs ")))
               .when((scan + idx) % 7 == 3, F.replace(text, F.lit(" g"), F.lit(" kg")))
               .when((scan + idx) % 7 == 5, F.replace(text, F.lit("Packed on"), F.lit("Pkd")))
               .otherwise(text))
    return (regions.filter((scan + idx * 3) % 10 != 0)
            .withColumns({"reader": F.lit("s"), "text": altered,
                          "confidence": ((scan * 17 + idx * 29) % 101).cast("double")}))


def label_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "label_meta", lambda: derive_meta(spark, sf_dir))


def derive_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue knowledge per label: category, tri-state flags, reference size, photo size."""
    rows = [(c, *L.CATALOGUE[c], *L.image_size(c)) for c in range(L.CASES)]
    cases = spark.createDataFrame(
        rows, "case_no int, commodity_category string, is_imported boolean, is_perishable_category boolean, "
              "is_medical_device boolean, is_combination_or_multipiece_package boolean, "
              "image_width_px int, image_height_px int")
    scan = F.col("scan_id")
    calibrated = (F.col("case_no") >= 12) & (F.floor(scan / L.CASES) % 2 == 0)
    return (table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"))
            .withColumn("case_no", (scan % L.CASES).cast("int")).join(F.broadcast(cases), "case_no")
            .withColumns({
                "reference_width_mm": F.when(calibrated, (40 + scan % 200).cast("double")),
                "reference_height_mm": F.when(calibrated, (30 + scan % 310).cast("double"))}))


def expected_verdicts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.EXPECTED, "case_no int, rule_id string, expected string")


def label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw word rows: text boxes cut at blanks, with uneven gaps, tilt and junk confidences."""
    r = label_regions(spark, sf_dir).withColumn("words", F.split("text", " "))
    cut = r.select("*", F.posexplode("words").alias("pos", "word"))
    scan, idx, pos = F.col("scan_id"), F.col("region_idx"), F.col("pos")
    before = F.length(F.array_join(F.slice("words", 1, pos), " "))
    return cut.select(
        "scan_id", "reader", (idx * 100 + pos).cast("int").alias("word_idx"),
        F.when((scan + pos) % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "word")).alias("text"),
        F.when((scan + pos) % 13 == 5, F.lit("-1")).when((scan + pos) % 13 == 7, F.lit("n/a"))
        .otherwise((30 + (scan * 3 + pos * 11 + idx) % 70).cast("string")).alias("conf"),
        (F.col("x") + before * 10 + pos * ((scan + idx) % 9) * 8).cast("int").alias("left"),
        (F.col("y") + (pos * 7 + scan) % 11 - 5).cast("int").alias("top"),
        (F.length("word") * 10).cast("int").alias("width"),
        (F.col("height") + pos % 3).cast("int").alias("height"))


def reader_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "reader_answers", lambda: derive_answers(spark, sf_dir))


def derive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies as a label-reading model returns them, some malformed or not an object."""
    b = label_base(spark, sf_dir)
    scan = F.col("scan_id")

    def text(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{key}": "'), value, F.lit('"'))

    keys = [
        text("manufacturer_name", F.when(scan % 3 == 0, F.concat(F.lit("Manufactured by "), "maker"))
             .when(scan % 3 == 1, F.col("maker")).otherwise(F.lit(" Null "))),
        text("manufacturer_address", F.when(scan % 2 == 0, F.col("nation")).otherwise(F.lit("not printed"))),
        F.when(scan % 5 == 0, text("country_of_origin", F.concat(F.lit("Product of "), "nation")))
        .otherwise(F.lit('"country_of_origin": null')),
        text("common_generic_name", F.when(scan % 4 == 0, F.lit("Snack")).otherwise(F.upper("name"))),
        F.when(scan % 7 == 0, F.concat(F.lit('"net_quantity_value": '), "qty"))
        .otherwise(text("net_quantity_value", F.col("qty"))),
        text("net_quantity_unit", F.when(scan % 6 == 0, F.lit("ml")).when(scan % 6 == 1, F.lit("KG"))
             .when(scan % 6 == 2, F.lit("bunch")).otherwise(F.lit("g"))),
        text("mfg_month_year", F.when(scan % 8 == 0, F.lit("N/A")).otherwise(F.col("month"))),
        text("mrp_value", F.when(scan % 9 == 0, F.lit("25.00")).otherwise(F.col("price"))),
        text("mrp_inclusive_of_taxes_stated", F.lit("yes")),
        text("consumer_care_phone", F.col("phone")),
        text("unit_sale_price", F.when(scan % 10 == 0, F.lit("  Rs. 0.62/g ")).otherwise(F.lit(""))),
    ]
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *keys), F.lit("}"))
    return b.filter(scan % 13 != 12).select("scan_id", (
        F.when(scan % 11 == 0, F.substring(whole, 1, 40))
        .when(scan % 37 == 1, F.lit('["not", "an object"]')).otherwise(whole)).alias("body"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.min("l_partkey").alias("product_id")))
    key = F.col("o_orderkey")
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    created = F.timestamp_seconds(day + key % 86400)
    return o.join(first, "o_orderkey", "left").select(
        key.alias("id"), "product_id",
        F.concat(F.lit("inspector"), F.col("o_custkey").cast("string"), F.lit("@example.org"))
        .alias("inspector_email"),
        F.when(F.col("o_orderstatus") == "F", K.FAIL).when(F.col("o_orderstatus") == "O", K.NEEDS_VERIFICATION)
        .otherwise(K.PASS).alias("overall_status"),
        F.when(key % 50 != 0, ((key * 37) % 1001).cast("double") / 10).alias("compliance_score"),
        F.when(key % 3 == 0, "tier2").otherwise("tier1").alias("font_size_tier"),
        F.lit(K.RULESET_VERSION).alias("ruleset_version"),
        created.alias("created_at"), F.to_date(created).alias("scan_date"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.concat(F.lit("inspector"), key.cast("string"), F.lit("@example.org")).alias("email"),
        F.when(key % 20 == 0, "admin").otherwise("inspector").alias("role"))


def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen results per scan with shared, missing and out-of-photo evidence boxes."""
    rules = F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(r).alias("rule_id"),
                               F.lit(K.RULES[r][0]).alias("rule_reference"),
                               F.lit(K.RULES[r][1]).alias("requirement_text"))
                      for i, r in enumerate(RULE_IDS)])
    scan, no = F.col("scan_id"), F.col("rule_no")
    k = ((scan * 3 + no) % 5).cast("int")
    statuses = F.array(*[F.lit(s) for s in K.SEVERITY])
    box = F.struct((k * 140 - 20).cast("int").alias("x"), (k * 55 + scan % 9).cast("int").alias("y"),
                   (120 + k * 10).cast("int").alias("width"), F.lit(20).alias("height"))
    # ids are few and small here but each becomes fourteen wide rows: spread them before that
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id")).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "scan_id")
    return (ids.select("scan_id", F.inline(rules))
            .select("scan_id", "rule_no", "rule_id", "rule_reference", "requirement_text",
                    F.element_at(statuses, ((scan * 7 + no * (scan % 3 + 1)) % 4 + 1).cast("int")).alias("status"),
                    F.struct(
                        F.when((scan + no) % 4 != 0, F.concat(F.lit("v"), no.cast("string")))
                        .alias("extracted_value"),
                        F.lit("ocr").alias("source"), F.lit(None).cast("string").alias("disagreement_note"),
                        F.when((scan + no) % 6 != 0, box).alias("bounding_box"),
                        F.lit(90.0).alias("ocr_confidence"), F.lit("eng").alias("language")).alias("evidence"),
                    F.when((scan + no) % 3 == 0, F.lit("")).otherwise(
                        F.concat(F.lit("note "), no.cast("string"))).alias("notes"),
                    F.lit(None).cast("string").alias("original_status"),
                    F.lit(None).cast("string").alias("verified_by"),
                    F.lit(None).cast("string").alias("verified_at"),
                    F.lit(None).cast("string").alias("verification_note")))


def verify_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests in a row name the same scan and rule; scans run over all keys and a little past them."""
    e = table(spark, sf_dir, "events")
    key, user = F.col("event_id"), F.col("user_id")
    pair = F.floor(key / 2)
    span = table(spark, sf_dir, "orders").agg((F.max("o_orderkey") * 21 / 20).cast("bigint").alias("span"))
    rules = F.array(*[F.lit(r) for r in RULE_IDS + ["R6-8", "R9-9"]])
    return e.select(
        key.alias("request_id"), F.col("ts").cast("timestamp").alias("ts"),
        ((pair * 7919) % span.scalar()).alias("scan_id"),
        F.element_at(rules, (pair % 16 + 1).cast("int")).alias("rule_id"),
        F.concat(F.lit("user"), user.cast("string"), F.lit("@example.org")).alias("email"),
        F.when(user % 3 == 2, "inspector").otherwise("admin").alias("role"),
        F.when(key % 4 == 0, F.lit("   ")).when(key % 4 == 1, F.concat(F.lit(" checked "), key.cast("string")))
        .alias("note"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("arrival_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(user % 5 != 0, F.concat(F.lit("user"), user.cast("string"), F.lit("@example.org"))).alias("email"),
        F.when(user % 10 != 0, F.concat(F.lit("10.0.0."), user.cast("string"))).alias("host"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    exts = F.array(*[F.lit(x) for x in
                     [".jpg", ".JPEG", ".png", ".webp", ".bmp", ".tif", ".tiff", ".gif", "", ".pdf", ".v2.jpg"]])
    kinds = F.array(*[F.lit(x).cast("string") for x in
                      [None, "image/jpeg", "image/png", "text/html", "", "image/webp", "image/gif"]])
    return table(spark, sf_dir, "documents").select(
        doc.alias("upload_id"),
        F.concat(F.lit("photo"), doc.cast("string"), F.element_at(exts, (doc % 11 + 1).cast("int"))).alias("filename"),
        F.element_at(kinds, (F.floor(doc / 11) % 7 + 1).cast("int")).alias("content_type"),
        F.when(doc % 29 == 0, F.lit(0).cast("bigint")).otherwise(F.col("n_chars") * 4096).alias("length"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document line and every label text, whole."""
    docs = (table(spark, sf_dir, "documents")
            .select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("src"),
                    F.posexplode(F.split("text", "\n")).alias("line_no", "line")))
    labels = label_regions(spark, sf_dir).select(
        F.concat(F.lit("s"), F.col("scan_id").cast("string")).alias("src"),
        F.col("region_idx").alias("line_no"), F.col("text").alias("line"))
    return docs.unionByName(labels)


def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("image_id"))
            .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.count(F.lit(1)).alias("n"))
            .select("image_id", (200 + (F.col("q") * 7) % 3300).cast("int").alias("width"),
                    (240 + (F.col("q") * 11 + F.col("n") * 97) % 2900).cast("int").alias("height"),
                    (F.col("q") % 173 + F.col("n") * 4).cast("double").alias("laplacian_variance")))


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, no = F.col("l_partkey"), F.col("l_linenumber").cast("bigint")
    q = F.col("l_quantity").cast("bigint")
    dx = F.when(part % 17 == 3, -q * 5).otherwise(q * 13 % 400)
    wobble = F.when((no + q) % (2 + part % 6) == 0, 40 + q).otherwise(F.lit(0))
    dy = F.floor(dx * (part % 9) / 50).cast("bigint") + wobble
    x1, y1 = F.col("l_orderkey") % 1000, F.col("l_suppkey") % 700
    return table(spark, sf_dir, "lineitem").select(
        part.alias("image_id"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"),
        (x1 + dx).cast("int").alias("x2"), (y1 + dy).cast("int").alias("y2"))


def component_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("image_id"),
        ((F.col("l_quantity").cast("bigint") * (1 + F.col("l_partkey") % 4)) % 97).cast("int").alias("h"))
