"""Token counts: an exact histogram of encoded lengths answers every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import prefix_sums, stored
from millrace.llm.encoding import VOCABULARY, encoder, in_chunks


def token_lengths(docs: DataFrame, *, text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length): the number of ids of each whole text."""
    schema = T.StructType([T.StructField("length", T.LongType())])

    def count(batches):
        ids_of = encoder(vocabulary)
        for batch in batches:
            lengths = [len(ids) // 4 for _, chunk in in_chunks(batch.column(0).to_pylist()) for ids in ids_of.encode(chunk)]
            yield pa.record_batch([pa.array(lengths, pa.int64())], names=["length"])

    return docs.select(F.coalesce(F.col(text_column), F.lit("")).cast("binary")).mapInArrow(count, schema)


def length_table(docs: DataFrame, *, text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The exact histogram of encoded lengths with its running totals, one row per length that occurs.

    Columns: length; documents (of that length); documents_below, tokens_below (shorter ones);
    documents_from, tokens_from (this length and more, the suffix sums); tokens_cut (all tokens, when each
    document is cut at this length); quantile (share of documents up to this length). The histogram is a
    partial aggregate, so its shuffle holds lengths and not documents; the sums are distributed, so a
    length may have any value. A null or empty text has length 0; repeated rows count each; an empty table
    gives no rows; other columns are not read.
    """
    counted = stored(token_lengths(docs, text_column=text_column, vocabulary=vocabulary)
                     .groupBy("length").agg(F.count("*").alias("documents")), "lengths")
    tokens = F.col("length") * F.col("documents")
    below = prefix_sums(counted, [F.col("length")], {"documents_below": F.col("documents"), "tokens_below": tokens}, "length_sums")
    all_documents, all_tokens = counted.agg(F.sum("documents"), F.sum(tokens)).first()
    return below.select(
        "length", "documents", "documents_below", "tokens_below",
        (F.lit(all_documents) - F.col("documents_below")).alias("documents_from"),
        (F.lit(all_tokens) - F.col("tokens_below")).alias("tokens_from"),
        (F.col("tokens_below") + F.col("length") * (F.lit(all_documents) - F.col("documents_below"))).alias("tokens_cut"),
        ((F.col("documents_below") + F.col("documents")) / F.lit(all_documents)).alias("quantile"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents within it, tokens kept when longer ones are cut, and tokens lost.

    Read from the histogram of ``length_table``; a limit that no document has is answered as well.
    """
    limit = F.explode(F.array(*[F.lit(n).cast("bigint") for n in limits])).alias("context")
    size, count = F.col("length"), F.col("documents")
    within = F.when(size <= F.col("context"), count).otherwise(0)
    kept = F.least(size, F.col("context")) * count
    return table.select("length", "documents", limit).groupBy("context").agg(
        F.sum(within).alias("documents_within"), F.sum(kept).alias("tokens_kept"),
        F.sum(size * count - kept).alias("tokens_lost"))
