"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, prefix_sums, renamed, stored, word_count


def random_key(id_column: Column, text: Column, seed: str) -> Column:
    """A reproducible random order: the MD5 of the seed and the id (without one, of the text's MD5)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.md5(text), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Words each source gives to the mix: ``share`` of all words dealt by weight, at most ``most`` times its own.

    ``sizes`` holds one row per source (source, source_size). Sources take the weights in turn, by code
    point, the null source last. What a full source cannot take goes to the others by weight: with the
    sources in order of capacity per weight, the common level is the largest of the levels that result
    from filling the sources before each one. Adds source_before, the words of all earlier sources.
    """
    by_name = [F.col("source").asc_nulls_last()]
    ranked = prefix_sums(sizes, by_name, {"source_before": F.col("source_size"), "nth": F.lit(1)}, "mix_sources")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    weighed = (ranked.withColumn("weight", turn.cast("bigint"))
               .withColumn("most", F.col("source_size") * most)
               .withColumn("ratio", F.col("most") / F.col("weight")))
    filled = prefix_sums(weighed, [F.col("ratio"), *by_name],
                         {"full": F.col("most"), "weight_before": F.col("weight")}, "mix_levels")
    total, dealt = filled.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    levels = (F.lit((total or 0.0) * share) - F.col("full")) / (F.lit(dealt or 1) - F.col("weight_before"))
    level = filled.agg(F.max(levels)).first()[0] or 0.0
    return filled.select("source", "source_size", "source_before",
                         F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                source_column: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
                most: int = 2, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes.

    Documents get hash-random keys and are range-sorted by (source, key); a distributed prefix sum of
    their sizes gives each one its place in its source. A source whose target is above its size repeats
    whole epochs; the last epoch is cut at the exact budget, so one document per source may be taken in
    part and the words taken add up to the target, rounded down. A hot source spans many ranges.

    Returns one row per input row: doc_id, source, size, source_size, target, taken, key. A null text or
    an empty one has size 0 and is not taken; the null source is a source of its own; rows without an id
    are placed by their text; repeated rows tie, and rows of one id go by size, so reruns agree;
    an empty table gives no rows; other columns are not read.
    """
    sized = stored(docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
                               word_count(F.col(text_column)).alias("size"),
                               random_key(F.col(id_column), F.col(text_column), seed).alias("key")), "mix_sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most), "mix_targets")
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    placed = prefix_sums(sized, order, {"before": F.col("size")}, "mix_places")
    joined = placed.withColumnRenamed("source", "from").join(targets, F.col("from").eqNullSafe(F.col("source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("before") - F.col("source_before"))))
    return (joined.withColumn("epochs", epochs)
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"), "key"))


def mixed_documents(docs: DataFrame, *, seed: str = "mix", **options) -> DataFrame:
    """The documents of the mix, with their columns: a row for each epoch that takes a document.

    The document at a source's cut comes with its first words only, joined by single spaces. Text, n_chars
    (where present) and the number of rows change; a document that the mix does not take has no row.
    ``docs`` must have doc_id, text and source. Rows that share a key (repeated rows) each get the mean
    of what their key takes, rounded up. Nulls and empty tables as in ``mix_sources``.
    """
    taken = (mix_sources(docs, seed=seed, **options).groupBy("key", "source", "size")
             .agg(F.ceil(F.sum("taken") / F.count("*")).alias("_taken")).where("_taken > 0"))
    plain, own = renamed(docs)
    text, source = own["text"], own["source"]
    keyed = plain.select("*", word_count(F.col(text)).alias("_size"), random_key(F.col(own["doc_id"]), F.col(text), seed).alias("_key"))
    pairs = keyed.join(taken.withColumnsRenamed({"key": "_k", "source": "_s", "size": "_n"}),
                       (F.col("_key") == F.col("_k")) & (F.col("_size") == F.col("_n"))
                       & F.col(source).eqNullSafe(F.col("_s")))
    last = F.ceil(F.col("_taken") / F.col("_size")).cast("int") - 1
    copies = pairs.withColumn("_copy", F.explode(F.sequence(F.lit(0), last)))
    words = F.least(F.col("_size"), F.col("_taken") - F.col("_copy") * F.col("_size"))
    whole = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.slice(whole, F.lit(1), words.cast("int")), " ")
    changed = copies.withColumn(text, F.when(words < F.col("_size"), cut).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        changed = changed.withColumn(own["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return changed.select(*[F.col(new).alias(name) for name, new in own.items()])
