"""Pack documents into fixed-length sequences: a linear grouping scheme, then best fit."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import bounded_blocks, stored
from millrace.llm.encoding import VOCABULARY, encoder, in_chunks

PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
                      T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                      T.StructField("ids_crc32", T.LongType())])
SEGMENT = T.StructType([T.StructField(name, T.LongType()) for name in
                        ("length", "first", "stop", "each", "sequence", "place")])


def pieces(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = 4096,
           vocabulary: str = VOCABULARY, end_id: int = 1) -> DataFrame:
    """Encode each whole text, add the end id, and cut at ``capacity`` ids: one row per piece."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches):
        ids_of = encoder(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, chunk in in_chunks(texts):
                at, number, start, length, crc = [], [], [], [], []
                for i, packed in enumerate(ids_of.encode(chunk)):
                    packed += end
                    for n, low in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[low:low + 4 * capacity]
                        at.append(begin + i)
                        number.append(n)
                        start.append(low // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.record_batch([keys.take(pa.array(at, pa.int64())), pa.array(number, pa.int32()),
                                       pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                                       pa.array(crc, pa.int64())], names=PIECE.names)

    whole = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    return docs.select(F.col(id_column).cast("bigint"), whole).mapInArrow(encode, PIECE)


class Plan:
    """A packing of a length histogram, as runs of equal sequences.

    A run is (free, first sequence, sequences): that many sequences hold pieces of the same lengths and
    have the same room left. A segment says that pieces ``first`` to ``stop`` of a length go to
    consecutive sequences, ``each`` at a time, from ``place`` on. Both grow with the number of
    different lengths, at most ``capacity``, and not with the number of pieces.
    """

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.runs: list[tuple[int, int, int]] = []
        self.used: dict[int, int] = {}

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def put(self, length: int, count: int, each: int, sequence: int, place: int) -> None:
        first = self.used.get(length, 0)
        self.used[length] = first + count
        self.segments.append((length, first, first + count, each, sequence, place))

    def best_fit(self, length: int, count: int) -> None:
        """Put each piece into the fullest sequence that has room; a sequence takes all it can."""
        while count:
            at = bisect_left(self.runs, (length,))
            if at < len(self.runs):
                free, first, bins = self.runs.pop(at)
            else:
                free, bins = self.capacity, -(-count // (self.capacity // length))
                first = self.open(bins)
            each = free // length
            filled = min(bins, count // each)
            if filled:
                self.put(length, filled * each, each, first, self.capacity - free)
                count -= filled * each
                if free - each * length:
                    insort(self.runs, (free - each * length, first, filled))
            if filled < bins:
                if count:
                    self.put(length, count, each, first + filled, self.capacity - free)
                    insort(self.runs, (free - count * length, first + filled, 1))
                    filled, count = filled + 1, 0
                if filled < bins:
                    insort(self.runs, (free, first + filled, bins - filled))


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, dict[int, int]]]:
    """(how often, {size index: pieces}) for a few sizes: column generation, its solution rounded down.

    The linear program minimises sequences over all configurations; a dynamic programme over the
    capacity finds the configuration that the dual prices value most, until none is worth more than 1.
    """
    m = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    need = np.array(counts, dtype=float)
    amounts = need / np.diag(columns)
    for _ in range(rounds):
        prices = np.linalg.solve(columns.T, np.ones(m))
        value, column = _best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(columns, column)
        ratios = np.where(step > 1e-12, amounts / np.where(step > 1e-12, step, 1), np.inf)
        leaves = int(np.argmin(ratios))
        if not np.isfinite(ratios[leaves]):
            break
        columns[:, leaves] = column
        amounts = np.maximum(np.linalg.solve(columns, need), 0)
    left, chosen = list(counts), []
    for j in np.argsort(-amounts, kind="stable"):
        config = {i: int(columns[i, j]) for i in range(m) if columns[i, j] >= 1}
        times = min([int(amounts[j] + 1e-6), *(left[i] // n for i, n in config.items())]) if config else 0
        if times:
            chosen.append((times, config))
            for i, n in config.items():
                left[i] -= times * n
    return chosen


def _best_configuration(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, each size as often as fits."""
    best, last = np.zeros(capacity + 1), []
    for size, price in zip(sizes, prices):
        taken = np.zeros(capacity + 1, dtype=np.int64)
        if price > 1e-12:
            base = best
            best = base.copy()
            for n in range(1, capacity // size + 1):
                more = base[:capacity + 1 - n * size] + n * price
                better = more > best[n * size:] + 1e-12
                best[n * size:][better] = more[better]
                taken[n * size:][better] = n
        last.append(taken)
    column, room = np.zeros(len(sizes)), capacity
    for i in range(len(sizes) - 1, -1, -1):
        n = last[i][room]
        column[i] = n
        room -= n * sizes[i]
    return float(best[capacity]), column


def plan_packing(histogram: dict[int, int], capacity: int = 4096, *, groups: int = 40,
                 large: tuple[int, ...] = (2, 4, 8)) -> Plan:
    """Pack a histogram of lengths: the plan of fewest sequences among those for each bound of what is large.

    Rounding costs room where many lengths are large; the fewer are, the more is left to best fit.
    """
    return min((grouped_plan(histogram, capacity, groups, n) for n in large), key=lambda plan: plan.sequences)


def grouped_plan(histogram: dict[int, int], capacity: int, groups: int, large: int) -> Plan:
    """Pack a histogram of lengths by the linear grouping scheme.

    Full pieces stand alone. Lengths above ``capacity / large`` are sorted, longest first, and dealt into
    ``groups`` groups of equal cardinality whose lengths are rounded up to the group's longest; the few
    rounded sizes are packed by ``configurations``. The actual pieces take the places of the rounded
    ones in order, so that consecutive sequences hold equal lengths and form runs. Pieces that the
    rounded-down solution leaves, and then all small ones, longest first, go by best fit.
    """
    plan = Plan(capacity)
    if histogram.get(capacity):
        plan.put(capacity, histogram[capacity], 1, plan.open(histogram[capacity]), 0)
    lengths = sorted((n for n in histogram if 0 < n < capacity and histogram[n]), reverse=True)
    big = [n for n in lengths if n * large > capacity]
    total = sum(histogram[n] for n in big)
    rest: dict[int, int] = {n: histogram[n] for n in lengths if n * large <= capacity}
    if total:
        # Cut points of equal cardinality; a length may spread over several groups.
        ends = sorted({math.ceil(total * (g + 1) / groups) for g in range(groups)})
        grouped, group, seen = [[]], 0, 0
        for n in big:
            count = histogram[n]
            while count:
                part = min(count, ends[group] - seen)
                grouped[-1].append([n, part])
                seen, count = seen + part, count - part
                if seen == ends[group] and seen < total:
                    group += 1
                    grouped.append([])
        sizes, merged = [], []
        for members in grouped:
            if sizes and sizes[-1] == members[0][0]:
                merged[-1] += members
            else:
                sizes.append(members[0][0])
                merged.append(list(members))
        counts = [sum(c for _, c in members) for members in merged]
        for times, config in configurations(sizes, counts, capacity):
            _substitute(plan, times, [i for i, n in config.items() for _ in range(n)], merged)
        for members in merged:
            for n, count in members:
                rest[n] = rest.get(n, 0) + count
    for n in sorted(rest, reverse=True):
        if rest[n]:
            plan.best_fit(n, rest[n])
    return plan


def _substitute(plan: Plan, times: int, slots: list[int], groups: list[list[list[int]]]) -> None:
    """Fill ``times`` sequences of one configuration with the next actual pieces of its groups."""
    drawn = []
    for group in slots:
        parts, wanted = [], times
        while wanted:
            n, count = groups[group][0]
            part = min(count, wanted)
            parts.append((n, part))
            wanted -= part
            groups[group][0][1] -= part
            if groups[group][0][1] == 0:
                groups[group].pop(0)
        drawn.append(parts)
    cuts = sorted({0, times, *(sum(c for _, c in parts[:k]) for parts in drawn for k in range(len(parts)))})
    begin = plan.open(times)
    for low, high in zip(cuts, cuts[1:]):
        place = 0
        for parts in drawn:
            n = parts[0][0]
            plan.put(n, high - low, 1, begin + low, place)
            place += n
            parts[0] = (n, parts[0][1] - (high - low))
            if parts[0][1] == 0:
                parts.pop(0)
        if plan.capacity > place:
            insort(plan.runs, (plan.capacity - place, begin + low, high - low))


def pack(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = 4096,
         vocabulary: str = VOCABULARY, end_id: int = 1, block_rows: int = 50_000) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Only the histogram of piece lengths, at most ``capacity`` rows, goes to the driver, which plans runs of
    equal sequences; each piece then finds its sequence from its number among pieces of its length. The
    numbers come from counts per (length, hash block) and a window inside each block, so a length that a
    third of all pieces share is split over many blocks.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one
    piece of the end id; a longer text is cut into full pieces and a last one; rows without an id or with a
    repeated one are packed like others (equal pieces are interchangeable); an empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, id_column=id_column, text_column=text_column, capacity=capacity,
                        vocabulary=vocabulary, end_id=end_id), "pieces")
    blocks = bounded_blocks(cut.count(), block_rows)
    spread = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    counts = stored(spread.groupBy("length", "block").agg(F.count("*").alias("n")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    # At most a few segments for each of at most `capacity` lengths, whatever the number of pieces.
    segments = F.broadcast(spark.createDataFrame(pa.table(
        {name: pa.array([s[i] for s in plan.segments], pa.int64()) for i, name in enumerate(SEGMENT.names)})))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (spread.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "block"])
                .withColumn("rank", F.col("rank") + F.col("before")))
    placed = numbered.join(segments.withColumnRenamed("length", "of"),
                           (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first"))
                           & (F.col("rank") < F.col("stop")))
    step = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(step / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + (step % F.col("each")) * F.col("length")).cast("bigint").alias("offset"))
