"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.workspace import materialized

from . import (
    byte_bpe,
    html_extract,
    line_dedup,
    merge_automaton,
    merkle,
    packing,
    personal,
    pivot_search,
    quality,
    secrets,
    simhash,
    spelling,
    url_filter,
)
from .oracles import OP11_SQL, OP13_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length of every document."""
    pieces = packing.decompose(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


#: The contract's rules: verdict, and host with path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url: by rule, else by its path template."""
    found = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    voted = materialized(quality.votes(quality.measures(docs)).drop("text"), "quality-votes")
    return quality.judge(voted, quality.estimate(voted)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def _number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, in the plain text and under encodings."""
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(_number("base", kind) for kind in secrets.KINDS),
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
        "n_layers",
        "n_oversize",
    )


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = personal.find_personal(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(_number("base", kind) for kind in personal.KINDS),
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


def op7_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector, by integer inner product."""
    scaled = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    table = _table(spark, sf_dir, "embeddings").where(F.coalesce(finite, F.lit(False)))
    vectors = materialized(pivot_search.clean(table, "vec_id", scaled), "pivot-vectors")
    found = pivot_search.top_k(vectors, F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


OP7_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT q.vec_id AS query_id, q.e AS qe, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM met
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that no earlier line equals or nearly equals."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    import public_tokenizers

    ranks = _vocabulary("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near duplicates of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, its more frequent form and that form's root."""
    found = spelling.variants(_table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the tokenization automaton and the labels they decode to, as digests."""
    tokenizer = _vocabulary("word_bpe_49k.json")
    encoded = merge_automaton.encode(_table(spark, sf_dir, "documents"), tokenizer)
    return merge_automaton.decode(encoded, tokenizer).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document, and the root after tampering with some texts."""
    found = merkle.manifest(
        _table(spark, sf_dir, "documents"),
        changes={"text": F.replace("text", F.lit("\n"), F.lit(""))},
        where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0,
    )
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(), 256).alias("proof_sha256"),
        F.col("changed_root").alias("folded_root"), "verified",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_binary_packing": op1_binary_packing,
    "op2_url_templates": op2_url_templates,
    "op3_html_text": op3_html_text,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_personal": op6_personal,
    "op7_pivot_top_k": op7_pivot_top_k,
    "op8_line_dedup": op8_line_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_merge_automaton": op12_merge_automaton,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {"op7_pivot_top_k": OP7_SQL, "op11_spelling": OP11_SQL, "op13_merkle": OP13_SQL}
