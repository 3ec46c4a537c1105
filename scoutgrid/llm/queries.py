"""One query per operator over its whole table, in the form its contract fixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scoutgrid.llm import chat, decontaminate, divergence, jaccard_join, merkle, mil_quality, mixing, ppm, quality_rules, secret_scan, simhash, toxicity, url_filter

from scoutgrid.llm.text import held_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    hits = decontaminate.marked(docs, table(spark, folder, "benchmark"), keep=("doc_id",))
    return hits.select("row.doc_id", F.explode("hits").alias("hit")).select(
        "doc_id", F.col("hit.item").alias("item_id"), F.col("hit.start").alias("start_word"), F.col("hit.end").alias("end_word"),
        F.col("hit.distance").alias("distance"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, folder, "documents").select("doc_id", "text"), keep=("doc_id",))
    base = F.filter("spans", lambda s: s["kind"] != "named")
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), count("named"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard_join.joined(docs, k=3, percent=90).select(F.col("row").alias("doc_id"), "n_shingles", "component_id", "n_links")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
                                   ("org", "/fr/", "allow")], "host string, path string, verdict string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judged(pages, rules).select("row.page_id", "host", "path", "rule", "verdict")


def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ppm.scored(docs).select(F.col("row").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, folder, "labels")).withColumnRenamed("row", "doc_id")


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_quality_mil(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return mil_quality.scored(docs, table(spark, folder, "labels")).withColumnRenamed("row", "doc_id")


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    hard = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                 "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    read = chat.read_back(chat.conversations(chat.chained(rows, "conv_id", "turn")).withColumn("formatted_chars", F.length("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(F.col("root.key").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.col("formatted_chars").cast("long").alias("formatted_chars"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audited(table(spark, folder, "documents").select("text", "lang", "source"))


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, k=3, bits=2).select(
        F.col("row").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(held_out(docs["doc_id"], 2, 0), F.translate(docs["text"], "\n", "")).otherwise(docs["text"])
    proved = merkle.manifest(docs, claims={"text": tampered}).withColumn("folded_root", merkle.folded(F.col("claim"), F.col("path")))
    return proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_decontaminate, op2_secret_scan, op3_jaccard_join, op4_quality_rules, op5_url_filter, op6_lm_score,
    op7_toxicity, op8_source_mixing, op9_quality_mil, op10_chat_format,
    op11_source_divergence, op12_simhash, op13_merkle_manifest)}
