"""SimHash near-dedup: fingerprints of shingles, BK-trees per shard, connected groups."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import NO_ID, document_key, renamed, runs, stored
from millrace.llm.components import connected

BITS = 64


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the lower-cased (A-Z) words' shingles under XXH64 with seed 42; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths).tolist()
    stops = stops[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    found = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(found), 1 << 16):
        part = found[low:low + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                 shingle: int = 4) -> DataFrame:
    """(doc_id, tag, fp): the fingerprint of each whole text, as a signed 64-bit number, and a hash of the text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tag", T.IntegerType()),
                           T.StructField("fp", T.LongType())])

    def compute(batches):
        for batch in batches:
            found = np.array([fingerprint(text, shingle) for text in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=schema.names)

    body = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).cast("bigint"), F.hash(body), body.cast("binary")).mapInArrow(compute, schema)


class BKTree:
    """Values in a tree whose children are keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The new node's number, or that of the node which already holds the value."""
        at, values, children = 0, self.values, self.children
        if values:
            while True:
                distance = (value ^ values[at]).bit_count()
                if not distance:
                    return at
                below = children[at].get(distance)
                if below is None:
                    children[at][distance] = len(values)
                    break
                at = below
        values.append(value)
        children.append({})
        return len(values) - 1

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, node) of all values within the radius: only edges within it are followed."""
        found, open_nodes = [], [0] if self.values else []
        values, children = self.values, self.children
        while open_nodes:
            at = open_nodes.pop()
            distance = (value ^ values[at]).bit_count()
            if distance <= radius:
                found.append((distance, at))
            if children[at]:
                low, high = distance - radius, distance + radius
                open_nodes += [child for edge, child in children[at].items() if low <= edge <= high]
        return found


class Linker:
    """Joins values within a radius into groups, comparing balls instead of all pairs.

    The tree holds pivots. A value within half the radius of a pivot joins its ball: a ball's members are
    all within the radius of each other. A value looks up pivots within one and a half radii, and goes
    through a ball's members only where the ball isn't in its group yet. So a group of thousands of
    near copies costs a few lookups each and gives one link per value.
    """

    def __init__(self, radius: int):
        self.radius, self.half = radius, radius // 2
        self.tree, self.balls = BKTree(), []
        self.parent: dict[int, int] = {}

    def root(self, value: int) -> int:
        parent = self.parent
        while parent[value] != value:
            parent[value] = parent[parent[value]]
            value = parent[value]
        return value

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def meet(self, value: int, keep: bool) -> None:
        """Link a value to all held ones within the radius; ``keep`` it for later ones."""
        if value in self.parent and keep:
            return
        self.parent.setdefault(value, value)
        near = self.tree.within(value, self.radius + self.half)
        near.sort()
        for distance, node in near:
            pivot = self.tree.values[node]
            if distance <= self.radius:
                self.join(value, pivot)
            elif self.root(value) != self.root(pivot):
                if any((value ^ other).bit_count() <= self.radius for other in self.balls[node]):
                    self.join(value, pivot)
        if keep:
            if near and near[0][0] <= self.half:
                self.balls[near[0][1]].append(value)
            else:
                node = self.tree.add(value)
                if node == len(self.balls):
                    self.balls.append([])


def shard_masks(radius: int) -> list[int]:
    """Masks of which two values within ``radius`` bits agree on at least one.

    The bits are cut into radius + 2 blocks; ``radius`` different bits touch at most ``radius`` of them, so
    two blocks are equal.
    """
    count = radius + 2
    cuts = [BITS * i // count for i in range(count + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def links(values: DataFrame, *, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """(a, b): enough links between different fingerprints to connect all that are within ``radius`` bits.

    Fingerprints that agree on two of six bit blocks share a shard; a link's ends share one at least.
    A shard of more than ``shard_rows`` values is dealt into chunks, and each pair of chunks is a task of
    its own. A task builds the BK-tree of one chunk and looks up the values of the other. All trees
    together grow with the input, so they are not broadcast: values and trees meet by a shuffle.
    """
    masks = [_signed(m) for m in shard_masks(radius)]
    shard = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    members = stored(values.select("fp", F.explode(shard).alias("shard")), "simhash_shards")
    shared = members.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / shard_rows).cast("int")
    mine = F.pmod(F.hash("fp"), F.col("chunks"))
    dealt = (members.join(shared, "shard").withColumn("chunks", chunks).withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("shard", F.least("mine", "other").alias("tree"), F.greatest("mine", "other").alias("asks"),
                     (F.col("mine") <= F.col("other")).alias("held"), "fp"))
    keys = ["shard", "tree", "asks"]
    tasks = dealt.repartition(*keys).sortWithinPartitions(*keys, F.col("held").desc(), "fp")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    unsigned = (1 << BITS) - 1

    def connect(batches):
        a, b = [], []
        for _, rows in runs(batches, keys):
            if len(rows) == 2:
                x, y = rows[0][1], rows[1][1]
                if ((x ^ y) & unsigned).bit_count() <= radius:
                    a.append(x)
                    b.append(y)
            else:
                linker = Linker(radius)
                for held, fp in rows:
                    linker.meet(fp & unsigned, held)
                for value in linker.parent:
                    if (root := linker.root(value)) != value:
                        a.append(_signed(value))
                        b.append(_signed(root))
            if len(a) > 100_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=schema.names)
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=schema.names)

    return tasks.mapInArrow(connect, schema).distinct()


def marked_groups(docs: DataFrame, *, id_column: str, text_column: str, shingle: int, radius: int) -> DataFrame:
    """(doc_id, tag, fp, component, component_id) of each row; component is the group's smallest fingerprint."""
    marked = stored(fingerprints(docs, id_column=id_column, text_column=text_column, shingle=shingle), "simhash")
    values = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash_values")
    groups = connected(links(values, radius=radius))
    named = values.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.select("fp", "component").join(lows, "component")
    return marked.join(of, "fp").select("doc_id", "tag", "fp", "component", "component_id")


def near_groups(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4,
                radius: int = 4) -> DataFrame:
    """The fingerprint of each document and the group it belongs to.

    Equal fingerprints are one value from the start, so exact copies never multiply. Returns one row per
    input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of its group).
    A null, empty or blank text has fingerprint zero and links like any other; rows without an id take part
    (a group of such rows alone has a null component_id); repeated rows share a group; an empty table
    gives no rows; other columns are not read.
    """
    groups = marked_groups(docs, id_column=id_column, text_column=text_column, shingle=shingle, radius=radius)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4,
                radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, rows without an id after all others.

    Of repeated rows one stays, and of rows with one id and different texts the one of the smallest text
    hash. Nulls and empty tables as in ``near_groups``.
    """
    groups = marked_groups(docs, id_column=id_column, text_column=text_column, shingle=shingle, radius=radius)
    sid = F.coalesce("doc_id", F.lit(NO_ID))
    kept = groups.groupBy("component").agg(F.min(F.struct(sid.alias("_ksid"), F.col("tag").alias("_ktag"))).alias("k"))
    plain, own = renamed(docs)
    key = document_key(F.col(own[id_column]), F.col(own[text_column]))
    keyed = plain.select("*", *[c.alias(f"_{n}") for n, c in zip(("sid", "tag"), key)])
    joined = keyed.join(kept.select("k.*"), (F.col("_sid") == F.col("_ksid")) & (F.col("_tag") == F.col("_ktag")))
    return joined.dropDuplicates(["_sid", "_tag"]).select(*[F.col(new).alias(name) for name, new in own.items()])
