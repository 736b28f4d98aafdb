"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .bpe import bpe_encode_decode
from .common import table
from .decontaminate import decontaminate
from .html_text import extract
from .pii import surrogates
from .quality import quality, quality_model
from .simhash import near_duplicates
from .suffixes import remove_repeats
from .topk import top_k
from .toxicity import toxicity, toxicity_model


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_encode_decode(table(spark, sf_dir, "documents"), word_tokenizer()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The query must give the same rows each time; who replaces data for use passes a secret key.
PII_KEY = b"tessera-query"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "n_entities", "kinds", F.sha2("text", 256).alias("text_sha256"), "text")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding)
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_simhash": op1_simhash, "op2_bpe": op2_bpe, "op3_toxicity": op3_toxicity, "op4_suffixes": op4_suffixes, "op5_html": op5_html, "op6_pii": op6_pii, "op7_decontaminate": op7_decontaminate, "op8_licenses": op8_licenses, "op9_topk": op9_topk, "op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {"op8_licenses": licenses.oracle_sql(), "op9_topk": OP9_SQL}
