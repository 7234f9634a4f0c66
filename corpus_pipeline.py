"""Corpus pipeline: language ID, SimHash, repeated passages, benchmark leaks, mixing.

Every stage takes the columns of ``documents`` and, but for the last, returns
them; other columns are left out, whatever their names. ``run`` chains the stages
over ``documents``, each written to the shared folder and read again.

In all stages a text of any length is worked on whole, rows that are repeated or
share an id are rows of their own unless said otherwise, and an empty table gives
no rows. Null sources and languages are values like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.decontaminate import clean_only
from tidemark.llm.langid import UND, identify, is_held_out, train
from tidemark.llm.mixing import taken
from tidemark.llm.simhash import keep_one
from tidemark.llm.suffix_dedup import deduplicated

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language has a smaller share is in no known language.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, ``lang`` replaced by the predicted one.

    Goes: null texts, texts without a letter, and those without a clear language. A
    null ``lang`` is not learned from and is replaced like others. Of languages with
    the same score the first in code-point order is taken.
    """
    model = train(docs.where(~is_held_out()))
    found = identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one with the smallest id.

    Links are those of ``op5_simhash``, fingerprints at three or fewer differing bits by the
    generalised pigeonhole, and besides them a similarity of .8 on five-word shingles, which
    fingerprints of 64 bits show only in part.

    Texts without words, null ones too, are alike. Of rows that share an id one stays;
    rows without an id all stay, since none of them can be named.
    """
    return keep_one(docs.select(*COLUMNS))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start in a document with a smaller id.

    A document of which no word is left goes; ``n_chars`` follows the text. A null text
    stays null, and texts that had no word before stay. Rows that share an id take
    nothing from one another; a null id counts as larger than any other.
    """
    rows = docs.select(*COLUMNS)
    left = deduplicated(rows.withColumn("before", F.length("text")))
    changed = F.length("text") < F.col("before")
    gone = changed & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return left.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Texts that are null or without words hold none; items without an id count too.
    """
    return clean_only(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with their source's target and the words taken.

    A document is returned whole and once, however many of its words the mix takes
    or repeats: the shares of the mix are in ``taken``. Rows without an id and rows
    that share one are documents of their own, told apart by a key of the row; a null
    source is a source; documents without words, null ones too, take nothing and go.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    mixed = taken(rows, row_col="row").select("row", "size", "source_size", "target", "taken").where("taken > 0")
    return rows.join(mixed, "row").drop("row")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]

#: Neither fingerprints, suffixes nor permutations can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
