"""A corpus from raw documents to token ids: five stages, each one operator's decision.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Between stages the rows are written as Parquet
and read again. Rows without an id pass the stages that judge by id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import decontam, langid, linededup, ngramjoin, spm
from tidewake.llm.common import quoted, remainder, table, written

#: Documents whose best language has a lower mean probability are rejected, and those without a letter.
LEAST_LANGUAGE_SCORE = 0.35
TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read as one of the languages learned from two thirds of them."""
    net = langid.fit(docs, F.coalesce(remainder("doc_id", 3) != 1, F.lit(False)))
    return langid.keep(docs, net, LEAST_LANGUAGE_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stood earlier; documents of which nothing stays go."""
    taken = {c.lower() for c in docs.columns}
    n_lines, n_dropped = (next(n for i in range(len(taken) + 1) if (n := f"{name}{i}") not in taken) for name in ("lines", "dropped"))
    short = linededup.dedup(docs, lines_col=n_lines, dropped_col=n_dropped).where((F.col(n_dropped) == 0) | (F.trim(F.regexp_replace("text", "\n", " ")) != ""))
    return short.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(quoted(c)) for c in docs.columns))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of documents that are alike.

    Of rows of one id one stays, that of the least hash. Rows without an id all stay.
    """
    found = ngramjoin.join_components(docs, count_links=False)
    others = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    whole = docs.select("doc_id", F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    named = whole.withColumn("name", F.struct(F.xxhash64("row.text"), F.xxhash64("row"), F.xxhash64(F.lit(1), "row")))
    # Light rows first: each id's number of rows and the row that stays.
    firsts = named.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("name").alias("first"), F.count("*").alias("n"))
    kept = named.join(firsts.join(others, "doc_id", "left_anti"), "doc_id")
    once = kept.where("n = 1").select("row")
    again = kept.where("n > 1 AND name = first").groupBy("doc_id").agg(F.first("row").alias("row")).select("row")
    none = named.where(F.col("doc_id").isNull()).select("row")
    return once.union(again).union(none).select(*(F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and their digests."""
    encoded = spm.encode(docs, TOKENIZER)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the trained network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs


def queries() -> dict:
    """The pipeline as a query of (spark, sf_dir)."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """SQL of the pipeline, where there is any."""
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
