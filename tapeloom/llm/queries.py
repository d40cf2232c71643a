"""Registered queries of this folder: name -> run(spark, sf_dir), and SQL where SQL can say it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import conversation_repair, edit_embedding, language, latent_leaks, licences, merkle, paragraph_bands, preferences, quality, simhash, style_tree, token_counts, transducer
from .common import documents, pick

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def op1_preferences(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    made = preferences.format_pairs(preferences.with_swapped_reply(turns), "conv_id")
    return made.withColumns({c: preferences.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op2_language_id(spark, sf):
    docs = pick(documents(spark, sf), "doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.learn(docs, ~out)
    return (language.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous"))


def op3_main_text(spark, sf):
    return style_tree.extract(spark.read.parquet(f"{sf}/pages.parquet"))


def op4_decontamination(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return latent_leaks.leaks(documents(spark, sf), items)


def op5_simhash(spark, sf):
    return (simhash.near_duplicates(documents(spark, sf))
            .select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"))


def op6_licenses(spark, sf):
    return (licences.scan(documents(spark, sf), licences.known(spark))
            .withColumn("licenses", F.array_join("licenses", ",")))


def op7_token_counts(spark, sf):
    return token_counts.token_counts(documents(spark, sf), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)


def op8_paragraphs(spark, sf):
    return paragraph_bands.with_passages(documents(spark, sf)).drop("at")


def op9_edit_fingerprints(spark, sf):
    return edit_embedding.edited_fingerprints(documents(spark, sf))


def op10_bpe_round_trip(spark, sf):
    made = transducer.round_trip(documents(spark, sf), public_tokenizers.path(TOKENIZER))
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op11_merkle_manifest(spark, sf):
    return merkle.audit(documents(spark, sf))


def op12_conversation_repair(spark, sf):
    return conversation_repair.report(conversation_repair.damage(spark.read.parquet(f"{sf}/conversations.parquet")))


def op13_quality(spark, sf):
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return quality.quality(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), part)


QUERIES = {f.__name__: f for f in (
    op1_preferences, op2_language_id, op3_main_text, op4_decontamination, op5_simhash, op6_licenses, op7_token_counts, op8_paragraphs,
    op9_edit_fingerprints, op10_bpe_round_trip, op11_merkle_manifest, op12_conversation_repair, op13_quality)}
SQL: dict[str, str] = {"op1_preferences": preferences.SQL, "op6_licenses": licences.SQL, "op11_merkle_manifest": merkle.SQL,
       "op12_conversation_repair": conversation_repair.SQL}
