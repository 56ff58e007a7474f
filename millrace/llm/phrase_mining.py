"""Phrase collocations per language: best-first growth from prefixes, cut off by admissible score bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import stored

#: Bytes of text that a task works on at a time; a longer text is taken whole.
CHUNK_BYTES = 4_000_000
NO_LANG = "und"
UNIGRAMS = "lang string, key bigint, f bigint"
GRAMS = "key bigint, f bigint, s2 bigint, s3 bigint, s4 bigint"
EXACT = ("lang string, phrase string, size int, f bigint, first bigint, last bigint, before_low bigint, "
         "before_high bigint, after_low bigint, after_high bigint")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
#: Of the word hash: a number for each byte, and the multiplier of each next place.
_BYTES = np.random.default_rng(11).integers(0, 2 ** 64, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_JOIN = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """The words of some documents: a 64-bit key each (of word and language), the piece, and the place in the text."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        self.lower = _LOWER[raw]
        kind = _CLASS[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.total = len(self.starts)
        piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts] if self.total else np.zeros(0, np.int32)
        self.piece = np.concatenate([piece, np.full(5, -1, np.int32)])
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        owner = np.searchsorted(offsets, self.starts, side="right") - 1
        self.langs = sorted(set(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([number[lang] for lang in langs], dtype=np.int32)[owner]
        salt = np.array([xxhash.xxh3_64_intdigest(lang.encode()) for lang in self.langs], dtype=np.uint64)
        self.keys = np.concatenate([_mixed(self._hashes(kind == 0) ^ salt[self.lang]), np.zeros(5, np.uint64)])

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.zeros(0, dtype=np.uint64)
        sizes = self.ends - self.starts
        first = np.cumsum(sizes) - sizes
        powers = np.ones(int(sizes.max()), dtype=np.uint64)
        powers[1:] = _STEP
        powers = np.cumprod(powers)
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        values = _BYTES[self.lower[inside]] * powers[place]
        return np.add.reduceat(values, first) + sizes.astype(np.uint64)

    def fits(self, at: np.ndarray, size: int) -> np.ndarray:
        """Whether ``size`` words from each place lie in one piece."""
        return self.piece[np.minimum(at + size - 1, self.total + 4)] == self.piece[at]

    def joined(self, grams: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Keys of the phrases of ``size`` words at ``at``, out of the keys of their first words."""
        return _mixed(grams * _JOIN + self.keys[at + size - 1])

    def phrase_keys(self, at: np.ndarray, size: int) -> np.ndarray:
        grams = self.keys[at]
        for n in range(2, size + 1):
            grams = self.joined(grams, at, n)
        return grams

    def phrase(self, at: int, size: int) -> str:
        words = (self.lower[self.starts[i]:self.ends[i]].tobytes() for i in range(at, at + size))
        return b" ".join(words).decode("utf-8", "replace")


class Bits:
    """A set of keys as a bitmap of fixed size: never says no to a member, and seldom yes to another."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.shift = words, np.uint64(64 - bits)

    @classmethod
    def of(cls, keys: DataFrame, column: str = "key", bits: int = 24) -> Bits:
        """At most 2^bits / 64 numbers come to the driver, however many keys there are."""
        place = F.shiftrightunsigned(column, 64 - bits).alias("place")
        found = (keys.select(place).selectExpr("shiftright(place, 6) AS at", "shiftleft(1L, int(place & 63)) AS bit")
                 .groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow())
        words = np.zeros(max(1, 2 ** (bits - 6)), dtype=np.uint64)
        words[found["at"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
        return cls(words, bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> self.shift
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[Chunk]:
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            texts.append(text)
            langs.append(lang)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield Chunk(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Chunk(texts, langs)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(keys).view(np.int64))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by key, and under the null key all words of a language."""
    for chunk in _chunks(batches):
        keys, first, count = np.unique(chunk.keys[:chunk.total], return_index=True, return_counts=True)
        totals = np.bincount(chunk.lang, minlength=len(chunk.langs))
        lang = np.concatenate([chunk.lang[first], np.arange(len(chunk.langs))])
        all_keys = pa.array(np.concatenate([keys.view(np.int64), np.zeros(len(totals), np.int64)]),
                            mask=np.concatenate([np.zeros(len(keys), bool), np.ones(len(totals), bool)]))
        yield pa.RecordBatch.from_arrays([pa.array(chunk.langs).take(pa.array(lang)), all_keys,
                                          pa.array(np.concatenate([count, totals]))], ["lang", "key", "f"])


def _grown(size: int, frontier: Bits, frequent: Bits, prefixes: Bits | None) -> Callable:
    """Counts of phrases of ``size`` words: first word in the frontier, prefix counted before, last word frequent."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            at = np.flatnonzero(frontier.has(chunk.keys[:chunk.total]))
            at = at[chunk.fits(at, size)]
            at = at[frequent.has(chunk.keys[at + size - 1])]
            grams = chunk.phrase_keys(at, size - 1)
            if prefixes is not None:
                known = prefixes.has(grams)
                at, grams = at[known], grams[known]
            keys, first, times = np.unique(chunk.joined(grams, at, size), return_index=True, return_counts=True)
            rests = [_signed(chunk.phrase_keys(at[first] + size - n, n)) if n < size else pa.nulls(len(keys), pa.int64()) for n in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(times), *rests], ["key", "f", "s2", "s3", "s4"])
    return count


def _exact(sizes: Sequence[int], wanted: Bits) -> Callable:
    """Phrases of the wanted keys by text, with the smallest and largest key of the words before and after; 0 for none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            at, grams = np.arange(chunk.total), chunk.keys[:chunk.total]
            for size in range(2, max(sizes) + 1):
                inside = chunk.fits(at, size)
                at, grams = at[inside], grams[inside]
                grams = chunk.joined(grams, at, size)
                picked = np.flatnonzero(wanted.has(grams)) if size in sizes else np.zeros(0, np.int64)
                if not len(picked):
                    continue
                picked = picked[np.argsort(grams[picked], kind="stable")]
                here, keys = at[picked], grams[picked]
                bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                lone = np.uint64(0)
                before = np.where((here > 0) & (chunk.piece[here - 1] == chunk.piece[here]), chunk.keys[here - 1], lone)
                after = np.where(chunk.piece[here + size] == chunk.piece[here], chunk.keys[here + size], lone)
                first = here[bounds]
                ends = [_signed(f.reduceat(x.view(np.int64), bounds)) for x in (before, after) for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk.langs).take(pa.array(chunk.lang[first])), pa.array([chunk.phrase(i, size) for i in first.tolist()], pa.string()),
                     pa.array(np.full(len(first), size, np.int32)), pa.array(np.diff(np.append(bounds, len(keys)))),
                     _signed(chunk.keys[first]), _signed(chunk.keys[first + size - 1]), *ends],
                    [part.split()[0] for part in EXACT.split(", ")])
    return count


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), exact for counts below 10^18 whose product stays below 10^35."""
    wide = lambda c: c.cast("decimal(18,0)")
    whole = (wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")
    part = (wide(left) * wide(right)).cast("decimal(38,0)")
    return ((whole - whole % part).cast("decimal(38,0)") / part).cast("bigint")


def _scored(exact: DataFrame, found: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Surviving candidates with their lowest cut."""
    candidates = found.where("size = 5 OR NOT ((before_low = before_high AND before_low <> 0) OR (after_low = after_high AND after_low <> 0))")
    split = candidates.withColumn("w", F.split("phrase", " ", -1))
    cuts = split.select("lang", "phrase", "size", F.col("f").alias("a"), "first", "last", "w",
                        F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    part = lambda begin, length: F.array_join(F.slice("w", begin, length), " ")
    cuts = cuts.select("lang", "phrase", "size", "a", "k",
                       F.when(F.col("k") == 1, F.col("first")).alias("left_key"), F.when(F.col("k") > 1, part(F.lit(1), F.col("k"))).alias("left_text"),
                       F.when(F.col("k") == F.col("size") - 1, F.col("last")).alias("right_key"),
                       F.when(F.col("k") < F.col("size") - 1, part(F.col("k") + 1, F.col("size") - F.col("k"))).alias("right_text"))
    single = words.select("key", "f")
    phrases = exact.select("lang", "phrase", "f")
    for side in ("left", "right"):
        cuts = (cuts.join(single.withColumnsRenamed({"key": f"{side}_key", "f": f"{side}_word"}), f"{side}_key", "left")
                .join(phrases.withColumnsRenamed({"phrase": f"{side}_text", "f": f"{side}_phrase"}), ["lang", f"{side}_text"], "left")
                .withColumn(side, F.coalesce(f"{side}_word", f"{side}_phrase")))
    cuts = cuts.join(totals, "lang")
    scores = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("left"), F.col("right")))
    lowest = F.min(F.struct("score", "k", "left", "right")).alias("cut")
    return (scores.groupBy("lang", "phrase", "a", "n").agg(lowest)
            .select("lang", "phrase", "a", F.col("cut.left").alias("l"), F.col("cut.right").alias("r"), "n", F.col("cut.score").alias("score")))


def _ranked(survivors: DataFrame, top: int) -> DataFrame:
    place = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return survivors.withColumn("rank", F.row_number().over(place).cast("bigint")).where(F.col("rank") <= top)


def mine_phrases(docs: DataFrame, *, lang_column: str = "lang", text_column: str = "text", least: int = 100, top: int = 2000,
                 shares: Sequence[float] = (0.1, 0.4, 1.0), bits: int = 24) -> DataFrame:
    """The ``top`` phrases of 2 to 5 words of each language by their lowest cut, among those that occur ``least`` times.

    Texts in A-Z lower case fall into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and
    tabs. A cut scores floor(1000 a n / (l r)). A phrase whose every occurrence is preceded, or followed, by
    one and the same word is dropped: the longer phrase occurs as often.

    No phrase that starts with a word of f occurrences scores above 1000 n / f, since r >= a; so words are
    expanded from the rarest up, in bands that hold the given ``shares`` of each language's frequent
    words. In a band phrases grow word by word from prefixes that occur ``least`` times. The language is
    settled when its ``top``-th surviving score lies above the bound of every word not yet expanded; ties
    with the bound go on. Bitmaps of 2^bits bits, whatever the corpus, tell tasks what to count; they may let
    other phrases through, which exact counts by text remove. Every pass reads all texts again; only counts
    are shuffled, after a partial count in each task.

    Null languages are ``und``; null and empty texts have no words; ties go by a, then phrase; a repeated
    row counts again; an empty table gives none; other columns are not read.
    Returns lang, rank, phrase, a, l, r, n, score.
    """
    texts = docs.select(F.coalesce(F.col(lang_column), F.lit(NO_LANG)).alias("lang"), F.col(text_column).alias("text")).where("length(text) > 0")
    counted = stored(texts.mapInArrow(_word_counts, UNIGRAMS).groupBy("lang", "key").agg(F.sum("f").alias("f"))
                     .where(f"key IS NULL OR f >= {int(least)}"), "phrase_words")
    totals = counted.where("key IS NULL").select("lang", F.col("f").alias("n"))
    words = counted.where("key IS NOT NULL")
    frequent = Bits.of(words, bits=bits)
    pending, survivors = stored(_bands(words, shares), "phrase_bands"), None
    for band in range(len(shares)):
        here = pending.where(F.col("band") == band)
        if not here.isEmpty():
            found = _expand(texts, here, words, totals, frequent, least, bits)
            survivors = found if survivors is None else survivors.unionByName(found)
        if survivors is not None and band + 1 < len(shares):
            kth = _ranked(survivors, top).where(F.col("rank") == top).select("lang", F.col("score").alias("kth"))
            left = pending.where(F.col("band") > band)
            bound = left.groupBy("lang").agg(F.min("f").alias("rarest")).join(totals, "lang").join(kth, "lang")
            settled = bound.where(F.col("kth") > F.floor(1000 * F.col("n").cast("decimal(18,0)") / F.col("rarest"))).select("lang")
            pending = stored(left.join(settled, "lang", "left_anti"), "phrase_bands")
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    if survivors is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    return _ranked(survivors, top).select(*names)


def _bands(words: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(lang, key, f, band): the first band whose share of the language's frequent words takes in words as rare as this.

    Shares are read off a histogram of f by powers of 2^(1/4), so a band ends at such a power and all
    words of one f share a band.
    """
    binned = words.withColumn("bin", F.floor(4 * F.log2("f")).cast("int"))
    mass = binned.groupBy("lang", "bin").agg(F.sum("f").alias("mass"))
    upward = Window.partitionBy("lang").orderBy("bin")
    share = mass.select("lang", "bin", ((F.sum("mass").over(upward) - F.col("mass")) / F.sum("mass").over(Window.partitionBy("lang"))).alias("below"))
    band = sum((F.col("below") >= limit).cast("int") for limit in shares[:-1]) if len(shares) > 1 else F.lit(0)
    return binned.join(share, ["lang", "bin"]).select("lang", "key", "f", band.alias("band"))


def _expand(texts: DataFrame, frontier: DataFrame, words: DataFrame, totals: DataFrame, frequent: Bits, least: int, bits: int) -> DataFrame:
    """Surviving candidates that start with a word of the frontier, scored."""
    starts, prefixes, levels = Bits.of(frontier, bits=bits), None, []
    for size in range(2, 6):
        grown = (texts.mapInArrow(_grown(size, starts, frequent, prefixes), GRAMS)
                 .groupBy("key").agg(F.sum("f").alias("f"), *[F.min(f"s{n}").alias(f"s{n}") for n in (2, 3, 4)])
                 .where(F.col("f") >= least))
        levels.append(stored(grown, f"phrase_{size}"))
        if levels[-1].isEmpty():
            break
        prefixes = Bits.of(levels[-1], bits=bits)
    keys = levels[0].select("key")
    for level in levels[1:]:
        keys = keys.unionByName(level.select(F.explode(F.array("key", "s2", "s3", "s4")).alias("key")).where("key IS NOT NULL"))
    wanted = Bits.of(keys, bits=bits)
    exact = stored(texts.mapInArrow(_exact(range(2, 6), wanted), EXACT).groupBy("lang", "phrase", "size")
                   .agg(F.sum("f").alias("f"), F.min("first").alias("first"), F.min("last").alias("last"),
                        F.min("before_low").alias("before_low"), F.max("before_high").alias("before_high"),
                        F.min("after_low").alias("after_low"), F.max("after_high").alias("after_high"))
                   .where(F.col("f") >= least), "phrase_exact")
    # A phrase of another band may be there as the rest of a candidate; it is scored in its own.
    found = exact.join(frontier.select(F.col("key").alias("first")), "first", "left_semi")
    return stored(_scored(exact, found, words, totals), "phrase_scored")
