"""A pipeline from raw documents to token ids: five stages, each written as Parquet and read again by the next.

language_id   documents without a language (no letter, or no text) go; where no labelled row has a letter, the others stay all the same
line_dedup    lines that recur across documents are cut out, and documents of which nothing is left go
near_copies   of documents that five-word shingles link at a similarity of 0.8 or more, the one with the smallest id stays
decontaminate documents that hold benchmark items, verbatim or paraphrased, go
tokenize      byte-level BPE ids, and digests of the ids and of what they decode to

All stages work on whole texts, however long, and on every row that the stage before kept. Nulls may be in any column. Columns beside
doc_id and text pass through, also those named like what an operator adds; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import bpe, decontam, langid, line_dedup, ngram_join
from terrane.llm.store import Scratch


def _apart(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs an operator that adds columns; columns of ``docs`` that have these names are set apart meanwhile, under names not in use."""
    mark = "_held_"
    while any(c.startswith(mark) for c in docs.columns):
        mark = "_" + mark
    held = {c: mark + c for c in docs.columns if c in names}
    out = work(docs.withColumnsRenamed(held))
    return out.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts, and those without a letter, go; all others have a language and stay, repeated rows each.

    The model learns from the labelled rows of ``docs``, a bounded number each language. One that knows no language calls all texts
    unknown; then, too, only texts without a letter go.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    return _apart(docs, ("lang_pred", "score"), lambda d: langid.predict(d, model).where(F.col("lang_pred") != langid.UNKNOWN))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and rows all of whose lines went or of which blanks are left; n_chars follows the text.

    Null texts have no lines and stay, as do empty ones. The first of the documents that share a line keeps it: the smallest doc_id.
    Rows that repeat an id are one document there. Rows with a null id stay as they are.
    """
    out = _apart(docs, ("n_lines", "n_dropped"), lambda d: line_dedup.drop_lines(d).where((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", "\\s+", "")) != "")))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the rows with its smallest id stay; of rows that repeat an id and a text, one.

    Null and empty texts and those of blanks link with nothing. Rows with a null id link with nothing and stay, each.
    """
    groups = Scratch(spark, "groups").save(ngram_join.join(docs, size=5, percent=80).where("doc_id IS NOT NULL"), "groups")
    others = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    repeated = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    several = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(several.dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item of the benchmark go, repeated rows each; null and empty texts hold nothing and stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apart(docs, ("contaminated", "item_ids", "best_share"), lambda d: decontam.find(d, benchmark).where(~F.col("contaminated")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row: n_tokens, token_ids and the digests. Null and empty texts have no tokens; null ids stay null."""
    # Workers that have run the other stages have less memory to spare.
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"), remembered=120_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: SQL can express neither the kernels of the first stage nor the merges of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
