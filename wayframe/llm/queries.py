"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunkprint, linededup, mixing, ngramlm, packing, quality, simhash, urlfilter, vptree
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.windows(table(spark, sf_dir, "conversations"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", urlfilter.fetch_time(F.col("page_id")).alias("fetched"))
    return urlfilter.filter_urls(pages, urlfilter.list_entries(spark))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkprint.links(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.neighbours(table(spark, sf_dir, "embeddings"), every=vptree.EVERY)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), every=True)


def op10_ngramlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_chat, op3_urls, op4_simhash, op5_mixing, op6_chunks, op7_packing, op8_vptree, op9_lines, op10_ngramlm)}

SQL = {
    "op2_chat": chat.windows_sql(),
    "op3_urls": urlfilter.filter_sql(),
    "op5_mixing": mixing.schedule_sql(),
}
