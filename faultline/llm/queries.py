"""The thin registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.bitsliced import Index
from faultline.llm.bpe import digests, encode_decode
from faultline.llm.collision_ann import nearest_vectors
from faultline.llm.common import crc_mod, load
from faultline.llm.conversations import damage, repairs
from faultline.llm.conversations import digests as conversation_digests
from faultline.llm.html_crf import extract
from faultline.llm.mixing import mix_sources
from faultline.llm.ngram_join import ngram_components
from faultline.llm.oracle import SQL
from faultline.llm.packing import pack
from faultline.llm.pivot_dedup import near_duplicates
from faultline.llm.suffix_lm import lm_scores
from faultline.llm.surrogates import replace_private
from faultline.llm.toxicity import toxicity
from faultline.llm.url_cascade import judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        if name in SQL:
            ORACLE[name] = SQL[name]
        return fn

    return deco


@query("op3_ngram_jaccard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(load(spark, sf_dir, "documents"), n=3, num=9, den=10)


@query("op7_source_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)


@query("op10_pii_surrogates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_private(load(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_toxicity_pu")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 3) == 1
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, load(spark, sf_dir, "labels"), held_out, threshold=0.7)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op5_bpe_segment_tree")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


@query("op8_suffix_tree_lm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


@query("op9_html_crf")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op1_pivot_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"), threshold=0.95)


@query("op6_ann_collision")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=2)


@query("op11_bitsliced_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(load(spark, sf_dir, "documents")).search(load(spark, sf_dir, "benchmark"), k=10)


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(repairs(damage(load(spark, sf_dir, "conversations"))))


#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op2_url_cascade")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
