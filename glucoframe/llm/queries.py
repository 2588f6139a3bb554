"""The registered queries of this package, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoframe.llm import conversation_repair, fill_in_middle, html_main, licenses, lz_fingerprint, mixing, packing, piece_encoding, quality, resharding, simhash, url_rules, warc
from glucoframe.llm import sql
from glucoframe.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path of the ranks of the 50k byte-level BPE and its splitting pattern.

    The ids are those of byte_bpe_50k.json read by the tokenizers library; a test compares the two.
    """
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op1_license_digests(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "text_digest", "license", F.concat_ws(",", "notices").alias("notices"))


def op2_repetition_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents"))


def op3_site_templates(spark: SparkSession, folder: str) -> DataFrame:
    return html_main.main_text(table(spark, folder, "pages"))


def op4_dictionary_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    written = warc.write_archives(table(spark, folder, "pages"), archives)
    records = warc.read_archives(spark, archives, written)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OLD_SHARDS, NEW_SHARDS = 6, 8


def op5_flow_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """From six shards by source, of very unequal sizes, to eight even ones."""
    docs = table(spark, folder, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    old = resharding.store(docs, F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)), size, scratch_path(spark, "old-shards"))
    rows = resharding.reshard(old, resharding.plan(old, shards=NEW_SHARDS), scratch_path(spark, "new-shards"))
    crc = F.crc32(F.coalesce("row.text", F.lit("")).cast("binary"))
    return rows.select("row.doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"))


def op7_lz_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return lz_fingerprint.beside_next(table(spark, folder, "documents"))


def op8_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    chosen = mixing.sample(table(spark, folder, "documents"))
    return chosen.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies")


def op9_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, folder, "documents"), *vocabulary()))


def op10_segment_popcount(spark: SparkSession, folder: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, folder, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_chunk_memoization(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, folder, "documents"))
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


def op12_prefix_doubling(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversation_repair.damaged(table(spark, folder, "conversations"))
    return conversation_repair.digested(conversation_repair.repair(turns))


def op13_offset_encoding(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    made = piece_encoding.encode(table(spark, folder, "documents"), model)
    text = piece_encoding.decoded(F.col("ids"), model)
    spans = F.crc32(F.concat("starts", "ends"))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(text, 256).alias("decoded_sha256"), spans.alias("spans_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_digests": op1_license_digests,
    "op2_repetition_coverage": op2_repetition_coverage,
    "op3_site_templates": op3_site_templates,
    "op4_dictionary_warc": op4_dictionary_warc,
    "op5_flow_resharding": op5_flow_resharding,
    "op6_url_rules": op6_url_rules,
    "op7_lz_phrases": op7_lz_phrases,
    "op8_pareto_mix": op8_pareto_mix,
    "op9_mixture_packing": op9_mixture_packing,
    "op10_segment_popcount": op10_segment_popcount,
    "op11_chunk_memoization": op11_chunk_memoization,
    "op12_prefix_doubling": op12_prefix_doubling,
    "op13_offset_encoding": op13_offset_encoding,
}
SQL: dict[str, str] = sql.SQL
