"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_blocks, stored
from millrace.llm.vectors import best, questions, usable

#: Quantised components of this size and more do not fit a long.
MOST = 2.0 ** 63
SCHEMA = "query_id bigint, vh bigint, vec_id bigint, score bigint"


class BitSlicedIndex:
    """Rows of integers as bitmaps: slice b of attribute d holds bit b of that attribute, less its minimum."""

    def __init__(self, rows: np.ndarray):
        self.count = len(rows)
        self.low = rows.min(axis=0)
        shifted = (rows - self.low).astype(np.uint64)
        self.width = max(1, int(shifted.max()).bit_length())
        self.words = -(-self.count // 64)
        padded = np.zeros((64 * self.words, rows.shape[1]), dtype=np.uint64)
        padded[:self.count] = shifted
        # (attribute, bit, words)
        self.slices = np.stack([self._bitmap(((padded >> np.uint64(b)) & np.uint64(1)).T) for b in range(self.width)], axis=1)
        self.everyone = self._bitmap((np.arange(64 * self.words) < self.count)[None, :])[0]

    @staticmethod
    def _bitmap(bits: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")).view("<u8")

    def sums(self, weights: np.ndarray) -> tuple[np.ndarray, int]:
        """(slices, constant): each row's inner product with ``weights`` is its number in the slices plus the constant.

        A weight adds its attribute's slices once per bit of its magnitude, shifted; a negative one adds
        the complement and lowers the constant. Slices are added three at a time by carry-save adders,
        which need bitmap operations only.
        """
        top = (1 << self.width) - 1
        constant = int(np.dot(weights.astype(object), self.low.astype(object)))
        constant += sum(int(w) * top for w in weights if w < 0)
        magnitude = np.abs(weights)
        terms: dict[int, list[np.ndarray]] = {}
        for sign, group in ((1, weights > 0), (-1, weights < 0)):
            for d in np.flatnonzero(group):
                value = self.slices[d] if sign > 0 else ~self.slices[d]
                for bit in range(int(magnitude[d]).bit_length()):
                    if int(magnitude[d]) >> bit & 1:
                        terms.setdefault(bit, []).append(value)
        # From the highest bit of the weights down: double what there is, then add this bit's terms.
        total = np.zeros((1, self.words), dtype=np.uint64)
        for bit in range(max(terms, default=0), -1, -1):
            total = np.concatenate([np.zeros((1, self.words), dtype=np.uint64), total])
            if bit in terms:
                total = _added(total, np.stack(terms[bit]))
        return total, constant

    def top(self, slices: np.ndarray, k: int, taking_part: np.ndarray) -> np.ndarray:
        """Numbers of the ``k`` rows with the greatest sums; of equal ones, those of smaller numbers.

        From the most significant slice down, rows are certain, out, or still equal; what is still equal
        after the last slice ties exactly, and fills the remaining places in row order.
        """
        certain, equal = np.zeros(self.words, dtype=np.uint64), taking_part.copy()
        have = 0
        for plane in slices[::-1]:
            higher = equal & plane
            n = have + int(np.bitwise_count(higher).sum())
            if n > k:
                equal = higher
            else:
                certain, equal, have = certain | higher, equal & ~plane, n
                if n == k:
                    break
        return np.sort(np.concatenate([self.numbers(certain), self.numbers(equal)[:k - have]]))

    @staticmethod
    def numbers(bitmap: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[at].view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
        word, bit = np.nonzero(bits)
        return at[word] * 64 + bit

    @staticmethod
    def values(slices: np.ndarray, numbers: np.ndarray) -> list[int]:
        bits = (slices[:, numbers // 64] >> (numbers % 64).astype(np.uint64)) & np.uint64(1)
        return [sum(int(b) << i for i, b in enumerate(column)) for column in bits.T]


def _added(total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """``total`` (bits, words) plus all ``terms`` (terms, bits, words)."""
    numbers = terms
    while len(numbers) > 2:
        third = len(numbers) // 3
        a, b, c = numbers[:third], numbers[third:2 * third], numbers[2 * third:3 * third]
        partial = a ^ b
        kept = partial ^ c
        carry = (a & b) | (partial & c)
        rest = numbers[3 * third:]
        wide = np.zeros((2 * third + len(rest), numbers.shape[1] + 1, numbers.shape[2]), dtype=np.uint64)
        wide[:third, :-1] = kept
        wide[third:2 * third, 1:] = carry
        wide[2 * third:, :-1] = rest
        numbers = wide
    for number in numbers:
        total = _rippled(total, number)
    return total


def _rippled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, bit by bit with a carry."""
    size = max(len(a), len(b)) + 1
    out = np.zeros((size, a.shape[1]), dtype=np.uint64)
    carry = np.zeros(a.shape[1], dtype=np.uint64)
    for i in range(size):
        x = a[i] if i < len(a) else None
        y = b[i] if i < len(b) else None
        if x is None and y is None:
            out[i] = carry
            break
        if x is None or y is None:
            only = y if x is None else x
            out[i] = only ^ carry
            carry = only & carry
        else:
            half = x ^ y
            out[i] = half ^ carry
            carry = (x & y) | (half & carry)
    return out


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, kind, ids, vh, vectors) of rows that lie together, out of sorted batches."""
    for batch in batches:
        dim, block, part, kind = (batch.column(name).to_numpy() for name in ("dim", "block", "part", "kind"))
        change = np.ones(batch.num_rows, dtype=bool)
        for column in (dim, block, part, kind):
            change[1:] &= column[1:] == column[:-1]
        change[1:] = ~change[1:]
        starts = np.flatnonzero(change)
        for low, high in zip(starts, np.append(starts[1:], batch.num_rows)):
            piece = batch.slice(low, high - low)
            vectors = piece.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(high - low, dim[low])
            yield (dim[low], block[low], part[low]), int(kind[low]), piece.column("vec_id").to_numpy(), piece.column("vh").to_numpy(), vectors


def _answers(k: int):
    """Index each block when its first query comes, and answer its queries one after the other."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, gathered, index = None, [], None
        for here, kind, its_ids, hashes, vectors in _segments(batches):
            if here != place:
                place, gathered, index = here, [], None
            if kind == 0:
                gathered.append((its_ids, vectors))
                continue
            if not gathered:
                continue
            if index is None:
                ids, q = (np.concatenate(parts) for parts in zip(*gathered))
                index = BitSlicedIndex(q)
            columns = [[], [], [], []]
            for query_id, vh, weights in zip(its_ids.tolist(), hashes.tolist(), vectors):
                others = index.everyone.copy()
                for at in range(*np.searchsorted(ids, [query_id, query_id + 1])):
                    if (q[at] == weights).all():
                        others[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
                        break
                slices, constant = index.sums(weights)
                found = index.top(slices, k, others)
                scores = [v + constant for v in index.values(slices, found)]
                for column, values in zip(columns, ([query_id] * len(found), [vh] * len(found), ids[found].tolist(), scores)):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [part.split()[0] for part in SCHEMA.split(", ")])
    return search


def exact_top(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20,
              every: int = 20, scale: int = 64, block_rows: int = 16_384, query_rows: int | None = None) -> DataFrame:
    """Each query's ``k`` rows of greatest integer inner product, exactly.

    Components become floor(scale * x). Rows are dealt by id into blocks, each indexed once by bit slices; the
    queries (ids divisible by ``every``) go to every block and stream through its index, which gives at most
    ``k`` rows per query. A task holds one block and one batch of queries. Only where there are fewer blocks than
    cores, or ``query_rows`` asks for parts of so many queries, is a block indexed for several parts of
    them. A query's own row doesn't count.

    Returns query_id, rank, vec_id, score. Null vectors, those with a null or non-finite component, without
    components or an id, take no part, nor do those with a quantised component that does not fit a long; sums
    are of any width, and a score among the best that does not fit a long fails the job. Vectors of
    different lengths never meet. A repeated row is a candidate as often as it occurs but one query; rows
    of one id with different vectors are queries of their own. An empty table gives no rows.
    """
    whole = F.transform("vector", lambda x: F.floor(x * scale))
    inside = F.forall("vector", lambda x: F.abs(x * scale) < MOST)
    rows = stored(usable(vectors, id_column, vector_column, zero=True).where(inside)
                  .select("vec_id", whole.cast("array<bigint>").alias("q"), "dim"), "slices")
    # Components are shuffled as narrow as all of them allow.
    low, high = rows.agg(F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    if max(-(low or 0), high or 0) < 2 ** 31:
        rows = rows.withColumn("q", F.col("q").cast("array<int>"))
    asked = stored(questions(rows, every, F.col("q")), "slice_queries")
    blocks = bounded_blocks(rows.count(), block_rows)
    parts = bounded_blocks(2 * vectors.sparkSession.sparkContext.defaultParallelism, blocks)
    if query_rows:
        parts = max(parts, bounded_blocks(asked.count(), query_rows))
    columns = ["dim", "block", "part", "kind", "vec_id", "vh", "q"]
    left = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "vec_id",
                       F.lit(0).cast("bigint").alias("vh"), "q")
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                         F.pmod(F.xxhash64("vec_id", "vh"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "vec_id", "vh", "q")
    dealt = left.select(columns).unionByName(right.select(columns)).repartition(blocks * parts, "dim", "block", "part")
    found = dealt.sortWithinPartitions("dim", "block", "part", "kind", "vec_id").mapInArrow(_answers(k), SCHEMA)
    return best(found, k, F.desc("score"))
