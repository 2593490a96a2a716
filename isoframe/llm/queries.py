"""The numbered queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm import collocations as op11
from isoframe.llm import decontaminate as op5
from isoframe.llm import exact_dedup as op8
from isoframe.llm import lm_automaton as op4
from isoframe.llm import merkle as op12
from isoframe.llm import minhash as op2
from isoframe.llm import packing as op7
from isoframe.llm import pieces as op13
from isoframe.llm import ppm_langid as op1
from isoframe.llm import sharding as op6
from isoframe.llm import substring_dedup as op10
from isoframe.llm import url_filters as op3
from isoframe.llm import warc as op9
from isoframe.llm.common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op1.identify(docs, op1.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op3.judge_urls(table(spark, sf_dir, "pages"), op3.rules_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_lm_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op4.score(docs, op4.fit(docs)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op5.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op6.shuffle_into_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    op9.write_archive(table(spark, sf_dir, "pages"), path)
    return op9.reconstruct(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op10.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.collocations(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    # tampering adds one to n_chars where 7 divides the crc of the id; decimals cannot overflow
    changed = [F.col(c) if c != "n_chars" else F.col(c).cast("decimal(20,0)") + 1 for c in fields]
    tampered = F.when(op12_tampered("doc_id"), op12.leaf(changed)).otherwise(op12.leaf([F.col(c) for c in fields]))
    out = op12.manifest(docs, fields, "lang", "doc_id", {"presented": tampered})
    out = out.withColumn("folded_root", op12.folded("presented", "path"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(op12.proof("path"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op13.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    spans = F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256")
    n_tokens = F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens")
    return found.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), spans)


def op12_tampered(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 0, F.lit(False))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ppm_langid, op2_minhash, op3_url_filters, op4_lm_automaton, op5_decontaminate, op6_sharding, op7_packing, op8_exact_dedup, op9_warc, op10_substring_dedup, op11_collocations, op12_merkle, op13_pieces]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": op3.ORACLE_SQL,
        "op5_decontaminate": op5.ORACLE_SQL,
        "op8_exact_dedup": op8.ORACLE_SQL,
        "op9_warc": op9.ORACLE_SQL,
        "op10_substring_dedup": op10.ORACLE_SQL,
        "op11_collocations": op11.ORACLE_SQL,
        "op12_merkle": op12.ORACLE_SQL,
    }
