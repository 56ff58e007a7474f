"""From raw documents to packed training sequences, in five stages.

quality     documents that the co-trained classifier rejects go
lines       later occurrences of repeated three-line windows go from the texts; a text that loses all its
            lines goes as a whole
near        one document of each group of near copies stays: the one of the smallest id
mix         each source gives words by its target weight: whole epochs, then a cut at the exact budget
pack        documents become pieces in sequences of at most 4096 tokens

All stages but the last return the columns of ``documents``, with ``n_chars`` kept in step with the text.
Null texts count as empty, rows without an id come after all others, and an empty table passes through;
each operator states its own cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import apart, stored
from millrace.llm.cotraining import keep_good
from millrace.llm.line_windows import drop_repeated_lines
from millrace.llm.mixing import mixed_documents
from millrace.llm.packing import pack
from millrace.llm.simhash_groups import one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    seen, gone = apart("_lines_seen", docs.columns), apart("_lines_gone", docs.columns)
    cut = drop_repeated_lines(docs, counts=(seen, gone))
    left = cut.where((F.col(gone) == 0) | (F.col(gone) < F.col(seen)))
    changed = F.when(F.col(gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.withColumn("n_chars", F.coalesce(changed, F.col("n_chars"))).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack_sequences)]

#: SQL can express neither the classifier nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``; what each one returns is stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
