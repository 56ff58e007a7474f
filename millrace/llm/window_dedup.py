"""Substring dedup: Rabin-Karp hashes of all windows of words, counted in Spark."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import document_key, stored

#: Multipliers of the two hashes: any odd numbers.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of the short hash by which windows are first told apart.
GRAM = 8
#: Words that a task hashes at a time.
CHUNK_WORDS = 1_000_000

ANCHOR = T.StructType([T.StructField("key", T.LongType()), T.StructField("seen", T.IntegerType()),
                       T.StructField("sid", T.LongType()), T.StructField("tag", T.IntegerType()),
                       T.StructField("at", T.IntegerType())])
WINDOW = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType()),
                       T.StructField("sid", T.LongType()), T.StructField("tag", T.IntegerType()),
                       T.StructField("at", T.IntegerType()), T.StructField("run", T.IntegerType())])
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                       T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def hashes(words: np.ndarray, base: int, *sizes: int) -> list[np.ndarray]:
    """Rabin-Karp hashes, modulo 2^64, of all windows of the given ascending sizes, built by doubling."""
    def joined(left, n_left, right, n_right):
        count = max(0, len(words) - n_left - n_right + 1)
        return left[:count] * np.uint64(pow(base, n_right, 2 ** 64)) + right[n_left:n_left + count]

    power = {1: words}
    while max(power) * 2 <= max(sizes):
        n = max(power)
        power[2 * n] = joined(power[n], n, power[n], n)
    out = []
    for size in sizes:
        whole, length = None, 0
        for n in sorted(power, reverse=True):
            if size & n:
                whole = power[n] if whole is None else joined(whole, length, power[n], n)
                length += n
        out.append(whole)
    return out


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``size`` consecutive values."""
    have, span = values, 1
    while span * 2 <= size:
        have = pick(have[:len(have) - span], have[span:])
        span *= 2
    rest = size - span
    return pick(have[:len(have) - rest], have[rest:]) if rest else have


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(32))


class Words:
    """Words of some documents in a row: their hashes, whose they are, and where each document starts."""

    def __init__(self, texts: list[list[bytes]]):
        self.counts = np.array([len(words) for words in texts], dtype=np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.total = int(self.counts.sum())
        flat = (xxhash.xxh3_64_intdigest(word) for words in texts for word in words)
        self.hashes = np.fromiter(flat, dtype=np.uint64, count=self.total)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    def whole(self, size: int) -> np.ndarray:
        """Which windows lie inside one document."""
        count = max(0, self.total - size + 1)
        return self.owner[:count] == self.owner[size - 1:size - 1 + count]


def _word_chunks(batch: pa.RecordBatch, column: int):
    """(row numbers, their words) in pieces of about ``CHUNK_WORDS`` words."""
    rows, texts, total = [], [], 0
    for row, text in enumerate(batch.column(column).to_pylist()):
        words = text.split()
        rows.append(row)
        texts.append(words)
        total += len(words)
        if total >= CHUNK_WORDS:
            yield rows, texts
            rows, texts, total = [], [], 0
    if rows:
        yield rows, texts


def anchors_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(short hashes, least short hash of each window, positions that are the least of some window).

    Equal windows have the same least short hash at the same offset, so a window whose least hash
    occurs at one position only, in all documents, is unique.
    """
    none = np.zeros(0, dtype=np.uint64)
    if words.total < size:
        return none, none, np.zeros(0, dtype=np.int64)
    short = _mixed(hashes(words.hashes, BASES[0], GRAM)[0])
    span = size - GRAM + 1
    least = sliding(short, span, np.minimum)
    inside = words.whole(size)
    pad = np.zeros(span - 1, dtype=np.uint64)
    cover = sliding(np.concatenate([pad, np.where(inside, least, 0), pad]), span, np.maximum)
    # An anchor is the least of a window over it: the greatest of those windows' leasts is its own hash.
    covered = sliding(np.concatenate([pad.astype(bool), inside, pad.astype(bool)]), span, np.logical_or)
    return short, least, np.flatnonzero((cover == short) & covered)


def anchors(docs: DataFrame, size: int) -> DataFrame:
    """(sid, tag, at): anchor positions whose short hash occurs more than once in all documents.

    ``docs`` has sid, tag and the text as binary. A task sends each hash it holds several times as one
    row with a count of 2, and its other positions, already known to repeat, under keys of their own: a
    phrase in a third of all documents then gives one row per chunk for its key. Places of one text's copies
    count once.
    """
    def find(batches):
        for batch in batches:
            sid, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, texts in _word_chunks(batch, 2):
                words = Words(texts)
                short, _, found = anchors_of(words, size)
                row = np.array(rows)[words.owner[found]] if len(found) else found
                at = found - words.starts[words.owner[found]] if len(found) else found
                key = short[found].view(np.int64)
                sids, tags, at = sid[row], tag[row], at.astype(np.int32)
                order = np.lexsort((sids, at, tags, key))
                key, sids, tags, at = key[order], sids[order], tags[order], at[order]
                other = key[1:] != key[:-1]
                fresh = np.concatenate([[True], other | (tags[1:] != tags[:-1]) | (at[1:] != at[:-1])])[:len(key)]
                key, sids, tags, at, order = key[fresh], sids[fresh], tags[fresh], at[fresh], order[fresh]
                _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                again = np.ones(len(key), dtype=bool)
                again[first] = False
                seen = np.minimum(count[inverse], 2).astype(np.int32)
                key = np.where(again, np.arange(len(key)) * 0x10001, key)
                # In the order of the documents, where neighbouring rows are alike and so small on disk.
                order = np.argsort(order)
                yield pa.record_batch([pa.array(x[order]) for x in (key, seen, sids, tags, at)], schema=_arrow(ANCHOR))

    found = docs.mapInArrow(find, ANCHOR)
    same, place = Window.partitionBy("key"), F.struct("tag", "at")
    repeats = (F.max("seen").over(same) > 1) | (F.min(place).over(same) != F.max(place).over(same))
    return found.withColumn("repeats", repeats).where("repeats").select("sid", "tag", "at")


def later_copies(docs: DataFrame) -> DataFrame:
    """(sid, tag) of documents whose whole text a document of a smaller id has: all their windows are later ones."""
    texts = docs.select("sid", "tag", F.octet_length("body").alias("n"), F.xxhash64("body").alias("h"))
    first = (texts.groupBy("tag", "n", "h").agg(F.min("sid").alias("first"), F.max("sid").alias("last"))
             .where("first < last").drop("last"))
    found = texts.join(first, ["tag", "n", "h"]).where(F.col("sid") > F.col("first"))
    return stored(found.select("sid", "tag").distinct(), "text_copies")


def repeated_runs(docs: DataFrame, *, size: int) -> DataFrame:
    """(sid, tag, runs): runs of window starts whose windows also start earlier, as start + length * 2^32.

    Copies of whole texts need no comparison: the first one has their windows.
    """
    copies = later_copies(docs)
    known = (anchors(docs.select("sid", "tag", "body"), size).groupBy("sid", "tag").agg(F.collect_list("at").alias("known"))
             .join(copies, ["sid", "tag"], "left_anti"))
    joined = (docs.join(known.withColumnsRenamed({"sid": "_sid", "tag": "_tag"}),
                        (F.col("sid") == F.col("_sid")) & (F.col("tag") == F.col("_tag")))
              .select("doc_id", "sid", "tag", "body", "known"))

    def find(batches):
        for batch in batches:
            sid, tag, known = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(4)
            for rows, texts in _word_chunks(batch, 3):
                words = Words(texts)
                short, least, _ = anchors_of(words, size)
                if not len(least):
                    continue
                marked = np.zeros(len(short), dtype=bool)
                for start, row in zip(words.starts.tolist(), rows):
                    marked[start + known[row].values.to_numpy(zero_copy_only=False)] = True
                rare = np.where(marked, short, np.uint64(2 ** 64 - 1))
                candidate = (sliding(rare, size - GRAM + 1, np.minimum) == least) & words.whole(size)
                begin = np.flatnonzero(candidate)
                if not len(begin):
                    continue
                h1 = hashes(words.hashes, BASES[0], size)[0][begin].view(np.int64)
                h2 = (_mixed(hashes(words.hashes, BASES[1], size)[0][begin]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                owner = words.owner[begin]
                row, at = np.array(rows)[owner], (begin - words.starts[owner]).astype(np.int32)
                yield from _first_and_later(h1, h2, sid[row], tag[row], at)

    windows = joined.mapInArrow(find, WINDOW)
    place = F.struct("sid", "tag", "at")
    first = F.min(place).over(Window.partitionBy("h1", "h2"))
    later = windows.withColumn("first", first).where((F.col("run") > 0) | (place != F.col("first")))
    run = F.col("at") + F.greatest("run", F.lit(1)).cast("bigint") * 2 ** 32
    whole = copies.select("sid", "tag", F.array(F.lit((2 ** 31 - 1) * 2 ** 32)).alias("runs"))
    return later.groupBy("sid", "tag").agg(F.collect_list(run).alias("runs")).unionByName(whole)


def _first_and_later(h1, h2, sid, tag, at):
    """The first of equal windows as one row each (run 0); the others, known to be later, as runs."""
    order = np.lexsort((at, tag, sid, h2, h1))
    h1, h2, sid, tag, at = h1[order], h2[order], sid[order], tag[order], at[order]
    fresh = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), 0))
    later = (sid != sid[head]) | (tag != tag[head]) | (at != at[head])
    # In the order of the documents, where neighbouring rows differ in few bytes and so are small on disk.
    kept = np.sort(order[fresh])
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    kept = back[kept]
    yield pa.record_batch([pa.array(x[kept]) for x in (h1, h2, sid, tag, at)]
                          + [pa.array(np.zeros(len(kept), dtype=np.int32))], schema=_arrow(WINDOW))
    if later.any():
        sid, tag, at = sid[later], tag[later], at[later]
        order = np.lexsort((at, tag, sid))
        sid, tag, at = sid[order], tag[order], at[order]
        cut = np.flatnonzero(np.concatenate(
            [[True], (sid[1:] != sid[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] > at[:-1] + 1)]))
        ends = np.concatenate([cut[1:], [len(at)]]) - 1
        # Their keys only spread them: a run needs no other row.
        yield pa.record_batch([pa.array(np.arange(len(cut), dtype=np.int64) * 0x10001), pa.array(np.full(len(cut), -1, dtype=np.int32)),
                               pa.array(sid[cut]), pa.array(tag[cut]), pa.array(at[cut]),
                               pa.array((at[ends] - at[cut] + 1).astype(np.int32))], schema=_arrow(WINDOW))


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema.fields])


def covered_words(count: int, runs: list[int] | None, size: int) -> np.ndarray:
    """Which of ``count`` words lie under a removed window: maximal intervals of merged runs."""
    if not runs or count < size:
        return np.zeros(count, dtype=bool)
    packed = np.array(runs, dtype=np.int64)
    begin, length = packed & 0xFFFFFFFF, packed >> 32
    edge = np.bincount(begin, minlength=count + 1) - np.bincount(
        np.minimum(count, begin + length + size - 1), minlength=count + 1)
    return np.cumsum(edge[:count]) > 0


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = 20,
                   with_text: bool = False) -> DataFrame:
    """What is left of each document when every repeated window of ``size`` words but its first goes.

    Every window gets Rabin-Karp hashes over its words. To send fewer of them, the least short hash of
    each window is counted first; only windows whose least short hash repeats can repeat, and those are
    compared by 96 bits across all documents. Positions of repeated windows merge into maximal intervals.
    The text is shuffled once, by document, for both joins.

    Returns doc_id, n_words, n_removed, kept_sha256 (and with ``with_text`` the kept words, joined by
    single spaces, as kept_text): one row per input row. A null or empty text has no words; a text shorter
    than a window keeps all; equal rows count as one document; rows without an id come after all others,
    those of one text counting as one document; an empty table gives no rows; other columns are not read.
    """
    if size < 2 * GRAM:
        raise ValueError(f"windows have at least {2 * GRAM} words")
    text = F.col(text_column)
    keyed = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), *document_key(F.col(id_column), text),
                        F.coalesce(text, F.lit("")).cast("binary").alias("body"))
    runs = repeated_runs(keyed, size=size).withColumnsRenamed({"sid": "_sid", "tag": "_tag"})
    joined = (keyed.join(runs, (F.col("sid") == F.col("_sid")) & (F.col("tag") == F.col("_tag")), "left")
              .select("doc_id", "body", "runs"))
    schema = T.StructType(RESULT.fields + [T.StructField("kept_text", T.BinaryType())] * with_text)

    def keep(batches):
        for batch in batches:
            counts, gone, digests, texts = [], [], [], []
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = body.split()
                counts.append(len(words))
                if found:
                    covered = covered_words(len(words), found, size)
                    gone.append(int(covered.sum()))
                    words = [] if gone[-1] == len(words) else [word for word, out in zip(words, covered.tolist()) if not out]
                else:
                    gone.append(0)
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                                   pa.array(digests, pa.string())] + [pa.array(texts, pa.binary())] * with_text,
                                  schema=_arrow(schema))

    result = joined.mapInArrow(keep, schema)
    return result.withColumn("kept_text", F.col("kept_text").cast("string")) if with_text else result
