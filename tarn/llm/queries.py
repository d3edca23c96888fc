"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import _sample, decontaminate, language, licenses, media, oracles, packing, quality, simhash, substring_dedup, toxicity, warc
from tarn.llm._store import documents, place


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def _held_out(modulus: int, value: int):
    return F.coalesce(_sample.remainder(modulus) == value, F.lit(False)).alias("held_out")


def op2_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = quality.train(docs, documents(spark, sf_dir, "doc_id", "quality", table="labels"))
    out = quality.score(docs, model, "doc_id")
    return out.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.train(docs, documents(spark, sf_dir, "doc_id", "toxic", table="labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir, "doc_id", "text"), documents(spark, sf_dir, "item_id", "text", table="benchmark"))


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(documents(spark, sf_dir, "page_id", "url", "html", table="pages"))
    return warc.read_archive(warc.read_files(spark, warc.write_files(archive, place(spark, "warc"))))


def op7_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return language.identify(docs, language.train(docs)).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir, "doc_id", "text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text")).drop("detections")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return op8_flac_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_substring_dedup,
        op2_rule_ensemble_quality,
        op3_nnpu_toxicity,
        op4_simhash_near_dedup,
        op5_spaced_seed_decontamination,
        op6_warc_segments,
        op7_byte_cnn_language,
        op8_flac_media,
        op9_license_scan,
        op10_best_fit_packing,
        media_payloads,
        license_base,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Of what SQL can express; the others have tests against plain forms."""
    return {
        "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op4_simhash_near_dedup": oracles.SIMHASH,
        "op5_spaced_seed_decontamination": oracles.DECONTAMINATION,
        "op6_warc_segments": oracles.WARC,
        "media_payloads": oracles.MEDIA_PAYLOADS,
        "license_base": oracles.license_base(licenses.BASE),
    }
