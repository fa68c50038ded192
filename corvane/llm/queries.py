"""The registered queries of this subpackage, one an operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, htmltext, jaccard, packing, quality, scratch, secrets, syncmers, tokenfile, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scratch.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch.path(spark, "token_file")
    tokenfile.write(table(spark, sf_dir, "documents"), at)
    return tokenfile.read(spark, at)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op4_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(chat.TOOLS, "name string, parameters string")
    return chat.format_chat(chat.with_tool_traffic(table(spark, sf_dir, "conversations")), tools)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), folded=True)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1,
    "op2_token_file": op2,
    "op3_ngram_jaccard_join": op3,
    "op4_chat_formatting": op4,
    "op5_document_fingerprints": op5,
    "op6_html_extraction": op6,
    "op7_decontamination": op7,
    "op8_quality": op8,
    "op9_toxicity": op9,
    "op10_secret_scan": op10,
}

#: Further uses of two operators: on tool traffic derived from the conversations, and whatever a passage's case and marks.
FURTHER: dict[str, Callable[[SparkSession, str], DataFrame]] = {"chat_tool_calls": op4_tools, "decontamination_folded": op7_folded}

#: Tokenizers, trained models, fingerprints and page trees have no SQL form.
SQL: dict[str, str] = {"op3_ngram_jaccard_join": jaccard.SQL, "op4_chat_formatting": chat.SQL, "chat_tool_calls": chat.TOOL_SQL, "op7_decontamination": decontam.SQL}
