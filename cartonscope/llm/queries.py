"""The queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartonscope.llm import (
    alignment,
    chat_format,
    decontamination,
    line_dedup,
    lm,
    merkle,
    mixing,
    near_dups,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_files,
    toxicity,
)
from cartonscope.llm.common import table

#: Places by which a term may be moved in a proximity match.
PROXIMITY_SLOP = 2


def vocabulary(name: str) -> str:
    """A file of the installed public tokenizers; machines of a cluster have it at the same place."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql("select cast(-1 as bigint) conv_id, cast(t as bigint) turn, role, text from values "
                      f"(0, 'user', '{control}'), (1, 'assistant', '{control}') as rows (t, role, text)")
    found = chat_format.examples(given.unionByName(added))
    # Each example gives its own reply; the last one holds all turns.
    read = found.select(
        "conv_id", "example", F.length("formatted").alias("chars"),
        chat_format.masked(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("reply"),
        F.when(F.col("last"), chat_format.read_back(F.col("formatted"))).alias("turns"))
    of_conv = read.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.max_by("turns", F.col("turns").isNotNull()).alias("turns"))
    loss = F.array_join("replies.reply", "")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return of_conv.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
                          F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                          F.col("formatted_chars").cast("long"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_n").alias("n_lines"), F.col("line_dropped").alias("n_dropped"),
                      F.sha2("line_kept", 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, sf_dir, "documents"))
    spans, listed = F.col("spans"), secret_scan.listed
    return found.select("doc_id", *[secret_scan.count_of(spans, k).alias(f"n_{k}") for k in secret_scan.BASE],
                        F.sha2(listed(secret_scan.base_spans(spans)), 256).alias("base_sha256"), listed(spans).alias("spans"))


def _contamination(spark: SparkSession, sf_dir: str, slop: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("bench_row"), "text")
    out = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), slop=slop)
    return out.select(F.col("bench_row").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort(F.array_distinct("items")), ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"), "near_items")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contamination(spark, sf_dir, 0).drop("near_items")


def op9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_decontamination, which stay exact, and the items that match only within PROXIMITY_SLOP places."""
    return _contamination(spark, sf_dir, PROXIMITY_SLOP)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    manifest = token_files.write(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), end_id=2, by_word=True)
    return token_files.documents(manifest, folder)


def merkle_digests(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and what a reader finds who sees a greater n_chars where 7 divides the id's crc32."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0  # null for a null id, which is left as it is
    tampered = merkle.leaf([F.col("n_chars") + F.when(hit, 1).otherwise(0) if i == 3 else c for i, c in enumerate(columns)])
    rows = merkle.manifest(docs, keep=[F.when(hit, tampered)])
    rows = rows.withColumn("folded_root", merkle.folded(F.coalesce("kept0", "leaf"), F.col("path")))
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_digests(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_near_duplicates, op3_mixing, op4_chat_format, op5_toxicity, op6_quality_rules,
                             op7_line_dedup, op8_secret_scan, op9_decontamination, op9_proximity, op10_quality_classifier, op11_token_files, op12_merkle_manifest, op13_alignment)}
