"""Explicit schemas of the tables the operators read and write."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height")])

REGION_ELEMENT = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("language", T.StringType())])

REGIONS = T.StructType([T.StructField("scan_id", T.LongType()), T.StructField("reader", T.StringType()),
                        T.StructField("region_idx", T.IntegerType()), *REGION_ELEMENT.fields])

RAW_PAYLOAD = T.MapType(T.StringType(), T.ArrayType(REGION_ELEMENT))

EXTRACTED = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("raw_text_span", T.StringType()),
    T.StructField("bounding_box", BOX), T.StructField("ocr_confidence", T.DoubleType()),
    T.StructField("language", T.StringType()), T.StructField("found", T.BooleanType()),
    T.StructField("source", T.StringType()), T.StructField("disagreement_note", T.StringType())])

EVIDENCE = T.StructType([
    T.StructField("extracted_value", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("disagreement_note", T.StringType()), T.StructField("bounding_box", BOX),
    T.StructField("ocr_confidence", T.DoubleType()), T.StructField("language", T.StringType())])

RULE_RESULT = T.StructType([
    T.StructField("rule_no", T.IntegerType()), T.StructField("rule_id", T.StringType()), T.StructField("rule_reference", T.StringType()),
    T.StructField("requirement_text", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("evidence", EVIDENCE), T.StructField("notes", T.StringType()),
    T.StructField("original_status", T.StringType()), T.StructField("verified_by", T.StringType()),
    T.StructField("verified_at", T.StringType()), T.StructField("verification_note", T.StringType())])

PRODUCTS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("brand", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("created_at", T.TimestampType())])

SCANS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("product_id", T.LongType()),
    T.StructField("inspector_email", T.StringType()), T.StructField("image_path", T.StringType()),
    T.StructField("preprocessed_image_path", T.StringType()),
    T.StructField("annotated_image_path", T.StringType()),
    T.StructField("raw_ocr_json", T.StringType()), T.StructField("declarations_json", T.StringType()),
    T.StructField("rule_results", T.ArrayType(RULE_RESULT)),
    T.StructField("ruleset_version", T.StringType()), T.StructField("overall_status", T.StringType()),
    T.StructField("compliance_score", T.DoubleType()), T.StructField("font_size_tier", T.StringType()),
    T.StructField("pdf_report_path", T.StringType()), T.StructField("docx_report_path", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("scan_date", T.DateType())])

USERS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("email", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("created_at", T.TimestampType())])

VERIFICATIONS = T.StructType([
    T.StructField("scan_id", T.LongType()), T.StructField("rule_id", T.StringType()),
    T.StructField("original_status", T.StringType()), T.StructField("new_status", T.StringType()),
    T.StructField("verified_by", T.StringType()), T.StructField("note", T.StringType()),
    T.StructField("created_at", T.TimestampType())])

REGISTER = {"products": PRODUCTS, "scans": SCANS, "users": USERS, "rule_verifications": VERIFICATIONS}
