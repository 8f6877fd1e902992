"""Sources: text boxes, raw word rows, upload metadata, reader answers, register tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartonscope import constants as K
from cartonscope import schemas as S
from cartonscope.functions import text as X
from cartonscope.operators.extraction import not_found


def read_regions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``parquet``/``json``: one row per box. ``payload``: (scan_id, raw_ocr_json) rows of a table."""
    if fmt == "payload":
        return explode_payload(spark.read.parquet(path))
    return spark.read.schema(S.REGIONS).format(fmt).load(path)


def explode_payload(scans: DataFrame, column: str = "raw_ocr_json") -> DataFrame:
    """One array of boxes per reader name -> one row per box, numbered by array position."""
    boxes = scans.select("scan_id", F.explode(F.from_json(column, S.RAW_PAYLOAD)).alias("reader", "boxes"))
    return boxes.select("scan_id", "reader", F.posexplode("boxes").alias("region_idx", "b")).select(
        "scan_id", "reader", "region_idx", "b.*")


def clean_words(words: DataFrame) -> DataFrame:
    """Trimmed, non-empty words with a confidence of at least 0 (unparsable counts as -1)."""
    conf = F.coalesce(F.expr("try_cast(conf AS DOUBLE)"), F.lit(-1.0))
    return (words.withColumns({"text": X.strip(F.col("text")), "confidence": conf})
            .filter((F.col("text") != "") & (F.col("confidence") >= 0))
            .select("scan_id", "reader", "word_idx", "text", F.col("left").alias("x"), F.col("top").alias("y"),
                    "width", "height", "confidence", F.lit(K.COMBINED_READER).alias("language")))


def upload_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and size of stored files; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("content_type"),
        "length")


def admit_uploads(files: DataFrame) -> DataFrame:
    """Adds ``reason``: the first failing check (extension, content type, empty, too large), or NULL."""
    ext = F.lower(F.regexp_extract(F.coalesce("filename", F.lit("")), r"[^./][^/]*(\.[^./]*)\z", 1))
    kind = F.coalesce("content_type", F.lit(""))
    reason = (F.when((ext != "") & ~ext.isin(*K.UPLOAD_EXTENSIONS), "extension")
              .when((kind != "") & ~kind.isin(*K.UPLOAD_CONTENT_TYPES), "content_type")
              .when(F.col("length") == 0, "empty").when(F.col("length") > K.MAX_UPLOAD_BYTES, "too_large"))
    return files.withColumns({"extension": ext, "reason": reason})


def answer_text(payload: Column) -> Column:
    """Joined text parts of the first candidate in a raw model response; NULL when unusable."""
    shape = "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"
    parts = F.try_element_at(F.from_json(payload, shape)["candidates"], F.lit(1))["content"]["parts"]
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def _answer_field(body: Column, name: str) -> Column:
    raw = F.try_variant_get(body, f"$.{name}", "variant")
    value = X.strip(F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(body, f"$.{name}", "string")))
    found = F.coalesce(value.isNotNull() & (value != "") & ~F.lower(value).isin(*K.ABSENT_ANSWERS), F.lit(False))
    return F.when(found, F.struct(
        value.alias("value"), value.alias("raw_text_span"), F.lit(None).cast(S.BOX).alias("bounding_box"),
        F.lit(None).cast("double").alias("ocr_confidence"), F.lit(None).cast("string").alias("language"),
        F.lit(True).alias("found"), F.lit("vision").alias("source"),
        F.lit(None).cast("string").alias("disagreement_note")).cast(S.EXTRACTED)).otherwise(not_found())


def usable_answers(answers: DataFrame, column: str = "body") -> DataFrame:
    """Adds the parsed body ``v``; a malformed or non-object body is no answer at all."""
    return answers.withColumn("v", F.try_parse_json(column)).filter(F.schema_of_variant("v").startswith("OBJECT"))


def parse_reader_answers(answers: DataFrame, column: str = "body") -> DataFrame:
    """One declarations row per usable answer."""
    fields = usable_answers(answers, column).select("scan_id", *[_answer_field(F.col("v"), f).alias(f) for f in K.DECLARATION_FIELDS])
    return fields.withColumns({
        "commodity_category": F.lit(None).cast(T.StringType()),
        "is_imported": F.when(F.col("country_of_origin.found"), F.lit(True))})


def read_register(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> dict[str, DataFrame]:
    """The four register tables, from files or over JDBC (``url`` and friends as options)."""
    if fmt == "jdbc":
        return {name: spark.read.format("jdbc").options(dbtable=name, **options).load() for name in S.REGISTER}
    return {name: read_table(spark, f"{path.rstrip('/')}/{name}", schema, fmt) for name, schema in S.REGISTER.items()}


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """One register table; partition columns that are not part of it are left out."""
    return spark.read.schema(schema).format(fmt).load(path).select(*schema.names)
