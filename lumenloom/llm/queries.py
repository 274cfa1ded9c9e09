"""The queries opN_<name> over the whole driver tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import quality, toxicity
from lumenloom.llm.minhash import near_duplicates
from lumenloom.llm.packing import pack_documents, pieces_of
from lumenloom.llm.pii import pseudonymize
from lumenloom.llm.runs import periodic_runs
from lumenloom.llm.setjoin import similar_sets
from lumenloom.llm.tokens import decode, encode, library_tokenizer, ranks_tokenizer, read_token_files, write_token_files
from lumenloom.llm.urlfilter import judge_urls
from lumenloom.llm.vptree import nearest
from lumenloom.llm.warc import read_archives, write_archives
from lumenloom.llm.whitening import whitened_embeddings

#: (allow or block, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_token_files(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, library_tokenizer, public_tokenizers.path(vocabulary), vocabulary=50_257, end_id=0)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    how = (ranks_tokenizer, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
    both = decode(encode(docs, *how).select("doc_id", "token_ids"), *how)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", (toxicity.fold_of() == 2).alias("held_out"), "score", "predicted")


def op2_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(docs, model)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The production key comes from the caller; this one is for tables of invented text.
DEMO_KEY = b"invented-text-only"


def op5_pii(spark: SparkSession, sf_dir: str, key: bytes = DEMO_KEY) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kinds = F.array_join(F.array_sort(F.array_distinct("pii.kind")), ",")
    return pseudonymize(docs, key).select("doc_id", "text", F.coalesce(F.size("pii"), F.lit(0)).cast("long").alias("n_pii"), kinds.alias("kinds"))


def pack_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Where the pieces of each document stand in training sequences of the ids that op4_token_files writes."""
    return pieces_of(pack_documents(docs, library_tokenizer, public_tokenizers.path(vocabulary)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document by its id's checksum repeats itself from a word on, as the contract of op11 says."""
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    n = F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i))), " ")
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    return some.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period")))), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, F.concat(r.period.cast("string"), F.lit("\n")))), "")
    found = periodic_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        (-F.col("best.less")).alias("length"),
        "best.period",
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
