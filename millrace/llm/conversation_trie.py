"""Conversation prefix trie: double arrays per shard of prefixes, and shared upper nodes merged globally."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import bounded_blocks, stored, word_count

#: Ids that one piece of a list of conversations holds.
PIECE = 4096
#: First cells that are tried for a node's children before the end of the array is taken.
TRIES = 64
#: Of a prefix: its depth and 128 bits of hash. The root has depth 0 and no bits.
PREFIX = ["pos", "p1", "p2"]
NODES = ("conv_id bigint, depth bigint, cut bigint, q1 bigint, q2 bigint, parent_conv_id bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint, ends bigint")
NOBODY = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, group: str, order: list[Column], label: str, **values: tuple[str, Column]) -> DataFrame:
    """Add running totals within ``group`` in ``order``, own row included: name=("sum" or "xor", value).

    Rows are range-partitioned and stored, so a group of any size spans many ranges; a group that goes on in
    the next range takes its total along, which is one row per range.
    """
    function = {"sum": F.sum, "xor": F.bit_xor}
    join = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    valued = df.select("*", *[value.alias(f"_v_{name}") for name, (_, value) in values.items()])
    ranged = stored(valued.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), label)
    totals = ranged.groupBy(group, "_part").agg(*[function[kind](f"_v_{name}").alias(name) for name, (kind, _) in values.items()])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (totals.select(F.col(group).alias("_group"), F.col("_part").alias("_at"),
                             *[function[kind](name).over(earlier).alias(f"_c_{name}") for name, (kind, _) in values.items()])
               .where(" OR ".join(f"_c_{name} IS NOT NULL" for name in values)))
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(*df.columns, "_part", *[function[kind](f"_v_{name}").over(inside).alias(f"_i_{name}")
                                                  for name, (kind, _) in values.items()])
    # Ranges are sorted by group, so at most one group goes on into each: the broadcast is a row per range.
    joined = local.join(F.broadcast(carried), (F.col("_group") == F.col(group)) & (F.col("_at") == F.col("_part")), "left")
    return joined.select(*df.columns, *[join[kind](F.col(f"_i_{name}"), F.coalesce(F.col(f"_c_{name}"), F.lit(0))).alias(name)
                                        for name, (kind, _) in values.items()])


def numbered_turns(conversations: DataFrame, *, id_column: str = "conv_id", turn_column: str = "turn",
                   role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, pos, k1, k2, words): the turns of each conversation from 1, by turn, nulls first.

    A turn is known by 120 bits of a digest of role and text, nulls as empty; turns of one number come in
    the order of their digests, and repeated rows are turns of their own. Rows without a conversation's id
    belong to none and are left out. ``words`` is the number of words of the text.
    """
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in (role_column, text_column))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring("_digest", at, 15), 16, 10).cast("bigint")
    turns = (conversations.select(F.col(id_column).cast("bigint").alias("conv_id"), F.col(turn_column).alias("turn"),
                                  digest.alias("_digest"), word_count(text).alias("words"))
             .where("conv_id IS NOT NULL").select("conv_id", "turn", half(1).alias("k1"), half(16).alias("k2"), "words"))
    order = [F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")]
    return running(turns, "conv_id", order, "trie_turns", pos=("sum", F.lit(1).cast("bigint"))).drop("turn")


def _own_hash(first: int) -> Column:
    return F.xxhash64(F.lit(first), "k1", "k2", "pos")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of at most ``PIECE`` ids out of sorted rows (len, p1, p2, conv_id), as text."""
    key, ids, rows = None, [], []

    def close():
        if ids:
            rows.append((*key, ids[0], len(ids), ",".join(map(str, ids))))

    for batch in batches:
        for *this, conv in zip(*(column.to_pylist() for column in batch.columns)):
            if this != key or len(ids) == PIECE:
                close()
                key, ids = this, []
            ids.append(conv)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["len", "p1", "p2", "rep", "n", "ids"])
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["len", "p1", "p2", "rep", "n", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (len, p1, p2): smallest id, number of ids and the digest of their list."""
    key, rep, count, digest, rows = None, None, 0, None, []
    for batch in batches:
        for *this, first, n, ids in zip(*(column.to_pylist() for column in batch.columns)):
            if this != key:
                if key is not None:
                    rows.append((*key, rep, count, digest.hexdigest()))
                key, rep, count, digest = this, first, 0, hashlib.sha256()
            digest.update(("," if count else "").encode() + ids.encode())
            count += n
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["len", "p1", "p2", "rep", "n", "sha"])
            rows.clear()
    if key is not None:
        rows.append((*key, rep, count, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["len", "p1", "p2", "rep", "n", "sha"])


def distinct_sequences(members: DataFrame) -> DataFrame:
    """Of (conv_id, len, p1, p2), one row per sequence: rep (smallest id), n (ids) and sha (of their list).

    Ids are joined to pieces where they lie in range order, so one sequence that a third of all
    conversations share is spread over ranges; only its pieces meet, read one after the other.
    """
    key = ["len", "p1", "p2"]
    pieces = (members.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
              .mapInArrow(_pieces, "len bigint, p1 bigint, p2 bigint, rep bigint, n bigint, ids string"))
    return (pieces.repartition(*key).sortWithinPartitions(*key, "rep")
            .mapInArrow(_digests, "len bigint, p1 bigint, p2 bigint, rep bigint, n bigint, sha string"))


class DoubleArray:
    """A trie in two arrays: the child of state s by code c is base[s] + c, if check of that cell is s.

    State 0 is the root. Cells are taken first-fit; a base may be negative, so any free cell can hold an only child.
    """

    def __init__(self, room: int = 1024):
        self.base = np.zeros(room, dtype=np.int64)
        self.check = np.full(room, -1, dtype=np.int64)
        self.check[0] = 0
        self.low, self.top = 1, 0

    def _grow(self, least: int) -> None:
        if least >= len(self.check):
            more = max(least + 1, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])

    def put(self, state: int, codes: np.ndarray) -> None:
        """Place the children of ``state``, given by ascending codes."""
        while self.low < len(self.check) and self.check[self.low] >= 0:
            self.low += 1
        span = int(codes[-1] - codes[0])
        self._grow(self.top + span + 2)
        first = self.low
        if len(codes) > 1:
            offsets = codes - codes[0]
            for _ in range(TRIES):
                if first > self.top or (self.check[first + offsets] < 0).all():
                    break
                first += 1
                while first <= self.top and self.check[first] >= 0:
                    first += 1
            else:
                first = self.top + 1
        cells = first + codes - codes[0]
        self._grow(int(cells[-1]))
        self.base[state] = first - codes[0]
        self.check[cells] = state
        self.top = max(self.top, int(cells[-1]))

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of ``states`` by ``codes``; -1 where there is none."""
        cells = self.base[states] + codes
        inside = (cells > 0) & (cells < len(self.check))
        return np.where(inside & (self.check[np.where(inside, cells, 0)] == states), cells, -1)


def dense(*columns: np.ndarray) -> np.ndarray:
    """Equal rows of ``columns`` get equal numbers from 0."""
    order = np.lexsort(columns)
    change = np.zeros(len(order), dtype=np.int64)
    for column in columns:
        change[1:] |= column[order][1:] != column[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(change)
    return out


class ShardTrie:
    """The trie of a shard's sequences, given as one array of turns with starts and lengths."""

    def __init__(self, turns: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.lengths = starts, lengths
        self.codes = np.full(int(turns.max()) + 1 if len(turns) else 0, -1, dtype=np.int64)
        self.turns, self.array, self.used = turns, DoubleArray(), 0
        self._build()

    def levels(self) -> Iterator[tuple[int, np.ndarray]]:
        """(depth from 0, sequences longer than it)."""
        active = np.arange(len(self.starts))
        for depth in range(int(self.lengths.max()) if len(self.lengths) else 0):
            active = active[self.lengths[active] > depth]
            yield depth, active

    def _build(self) -> None:
        """Level by level; turns are numbered as they come up under their parents, so siblings lie close."""
        states = np.zeros(len(self.starts), dtype=np.int64)
        for depth, active in self.levels():
            turns = self.turns[self.starts[active] + depth]
            order = np.lexsort((turns, states[active]))
            parent, turn = states[active][order], turns[order]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (parent[1:] != parent[:-1]) | (turn[1:] != turn[:-1])
            parent, turn = parent[fresh], turn[fresh]
            new, at = np.unique(turn[self.codes[turn] < 0], return_index=True)
            new = new[np.argsort(at)]
            self.codes[new] = self.used + np.arange(len(new))
            self.used += len(new)
            bounds = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            for a, b in zip(bounds, np.append(bounds[1:], len(parent))):
                self.array.put(int(parent[a]), np.sort(self.codes[turn[a:b]]))
            states[active] = self.array.step(states[active], self.codes[turns])

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth from 0, sequences, the state each one reaches there)."""
        states = np.zeros(len(self.starts), dtype=np.int64)
        for depth, active in self.levels():
            states[active] = self.array.step(states[active], self.codes[self.turns[self.starts[active] + depth]])
            yield depth, active, states[active]


def _shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard, with all sums over their subtrees."""
    rows = {name: table[name].to_numpy() for name in table.column_names}
    order = np.lexsort((rows["pos"], rows["rep"]))
    rows = {name: column[order] for name, column in rows.items()}
    first = np.append(True, rows["rep"][1:] != rows["rep"][:-1])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(first)))
    # A sequence starts below a shared prefix, so its first turn is told apart by the whole prefix.
    turns = dense(np.where(first, rows["r1"], rows["k1"]), np.where(first, rows["r2"], rows["k2"]), first.astype(np.int64))
    trie = ShardTrie(turns, starts, lengths)
    size = len(trie.array.check)
    count, conv, saved, ends = (np.zeros(size, dtype=np.int64) for _ in range(4))
    depth, row_of = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    conv[:], ends[:] = np.iinfo(np.int64).max, -1
    levels = []
    for at, active, states in trie.walk():
        here = starts[active] + at
        np.add.at(count, states, rows["n"][here])
        np.minimum.at(conv, states, rows["rep"][here])
        depth[states], row_of[states] = rows["pos"][here], here
        last = lengths[active] == at + 1
        ends[states[last]] = here[last]
        levels.append(np.unique(states))
    parent = trie.array.check
    children, leaves = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for states in reversed(levels):
        leaves[states] += children[states] == 0
        saved[states] += (count[states] - 1) * rows["words"][row_of[states]]
        for total, value in ((children, 1), (leaves, leaves[states]), (saved, saved[states])):
            np.add.at(total, parent[states], value)
    nodes = np.concatenate(levels)
    top, row, end = parent[nodes] == 0, row_of[nodes], ends[nodes]
    columns = [pa.array(conv[nodes]), pa.array(depth[nodes]),
               *[pa.array(rows[name][row], mask=~top) for name in ("cut", "q1", "q2")], pa.array(conv[parent[nodes]], mask=top),
               pa.array(count[nodes]), pa.array(children[nodes]), pa.array(leaves[nodes]), pa.array(saved[nodes]),
               pa.array(rows["rep"][np.maximum(end, 0)], mask=end < 0)]
    return pa.Table.from_arrays(columns, [part.split()[0] for part in NODES.split(", ")])


def _merged(upper: DataFrame, below: DataFrame) -> DataFrame:
    """Sums over subtrees of the shared nodes, by doubling: after k rounds a node has all within 2^k of it."""
    kids = upper.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("kids"))
    state = (upper.join(kids, "key", "left").join(below, "key", "left")
             .withColumn("n_children", F.coalesce("kids", F.lit(0)) + F.coalesce("roots", F.lit(0)))
             .select("key", "up", "n_children",
                     (F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("bigint")).alias("n_leaves"),
                     (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    state = stored(state, "trie_upper_0")
    deepest, round_ = upper.agg(F.max("key.pos")).first()[0] or 0, 0
    while 2 ** round_ <= deepest:
        sums = state.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        jumps = state.select(F.col("key").alias("up"), F.col("up").alias("next"))
        state = (state.join(sums, "key", "left").join(jumps, "up", "left")
                 .select("key", F.col("next").alias("up"), "n_children",
                         (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                         (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")))
        round_ += 1
        state = stored(state, f"trie_upper_{round_}")
    return state.drop("up")


def prefix_trie(turns: DataFrame, everyone: DataFrame, *, shard_turns: int = 65_536) -> DataFrame:
    """The nodes of the trie of conversations.

    ``turns`` has (conv_id, pos, k1, k2, words, len): turn ``pos`` (1 to ``len``, no gaps) of a conversation,
    its digest and number of words; ``everyone`` has one row for each conv_id, also of those without turns.
    Equal conversations become one sequence first. A prefix with more than ``shard_turns`` turns of
    distinct sequences at and below it is shared: it is merged globally, over all shards. What hangs
    below shared prefixes goes to shards by its first prefix; each shard packs BASE and CHECK arrays
    over its dense turn ids and walks them. The root is always shared.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Without conversations there is no node.
    """
    prefixed = running(turns.select("conv_id", "pos", "k1", "k2", "words", "len"), "conv_id", [F.col("pos")], "trie_prefixes",
                       p1=("xor", _own_hash(1)), p2=("xor", _own_hash(2)))
    prefixed = stored(prefixed, "trie_rows")
    members = prefixed.where("pos = len").select("conv_id", "len", "p1", "p2")
    zero = F.lit(0).cast("bigint")
    turnless = everyone.join(members, "conv_id", "left_anti").select("conv_id", zero.alias("len"), zero.alias("p1"), zero.alias("p2"))
    sequences = stored(distinct_sequences(members.unionByName(turnless)), "trie_sequences")

    rows = stored(prefixed.join(sequences.select(F.col("rep").alias("conv_id"), "n"), "conv_id")
                  .withColumnRenamed("conv_id", "rep"), "trie_distinct")
    heavy = stored(rows.groupBy(*PREFIX).agg(F.sum(F.col("len") - F.col("pos") + 1).alias("below"))
                   .where(F.col("below") > shard_turns).select(*PREFIX), "trie_shared")
    parent = [F.col("p1").bitwiseXOR(_own_hash(1)).alias("q1"), F.col("p2").bitwiseXOR(_own_hash(2)).alias("q2")]
    cuts = rows.join(heavy, PREFIX).groupBy("rep").agg(F.max("pos").alias("cut"))
    tops = stored(rows.join(cuts, "rep", "left").withColumn("cut", F.coalesce("cut", zero)).where("pos = cut + 1")
                  .select("rep", "cut", F.col("p1").alias("r1"), F.col("p2").alias("r2"), *parent), "trie_tops")
    # Twice the shards that would do: shards are dealt by hash.
    shards = 2 * bounded_blocks(rows.count(), shard_turns)
    light = (rows.join(tops, "rep").where("pos > cut")
             .withColumn("shard", F.pmod(F.xxhash64("r1", "r2"), F.lit(shards)))
             .select("shard", "rep", "pos", "k1", "k2", "words", "n", "cut", "r1", "r2", "q1", "q2"))
    nodes = stored(light.groupBy("shard").applyInArrow(_shard_nodes, NODES), "trie_nodes")

    shared = (rows.join(heavy, PREFIX).select("*", *parent).groupBy(*PREFIX)
              .agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("words").alias("words"),
                   F.max("q1").alias("q1"), F.max("q2").alias("q2"),
                   F.max(F.when(F.col("pos") == F.col("len"), F.col("rep"))).alias("ends")))
    key = F.struct(*PREFIX).alias("key")
    up = F.struct((F.col("pos") - 1).alias("pos"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).alias("up")
    root = (sequences.agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"),
                          F.max(F.when(F.col("len") == 0, F.col("rep"))).alias("ends")).where("conv_id IS NOT NULL")
            .select(F.struct(*[zero.alias(name) for name in PREFIX]).alias("key"), "conv_id", "n_convs", zero.alias("words"), "ends"))
    upper = stored(shared.select(key, up, "conv_id", "n_convs", "words", "ends")
                   .unionByName(root, allowMissingColumns=True), "trie_upper")
    place = F.struct(F.col("cut").alias("pos"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    below = (nodes.where("cut IS NOT NULL").groupBy(place.alias("key"))
             .agg(F.count("*").alias("roots"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
    names = upper.select(F.col("key").alias("up"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    merged = (upper.join(_merged(upper, below), "key").join(names, "up", "left")
              .withColumn("depth", F.col("key.pos")).withColumnRenamed("above", "parent_conv_id").select(*columns))
    lower = (nodes.withColumn("up", F.when(F.col("cut").isNotNull(), place)).join(names, "up", "left")
             .withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id")).select(*columns))
    lists = sequences.select(F.col("rep").alias("ends"), "sha")
    return (merged.unionByName(lower).join(lists, "ends", "left")
            .select(*columns[:-1], F.coalesce("sha", F.lit(NOBODY)).alias("ends_sha256")))


def with_shared_heads(turns: DataFrame, *, of: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share their heads: (turns with len, one row per conv_id).

    Conversation c starts with the first h turns of c - c % ``of`` (all if fewer, none if absent) and goes on
    with its own turns after its first h, where h is the CRC-32 of its decimal id modulo ``most``.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    ids = sizes.select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % of).alias("base"),
                       F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).alias("h"))
    bases = sizes.where(F.col("conv_id") % of == 0).select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    everyone = stored(ids.join(bases, "base", "left")
                      .withColumn("keep", F.least("h", F.coalesce("base_size", F.lit(0))))
                      .select("conv_id", "base", "h", "keep",
                              (F.col("keep") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("len")), "trie_heads")
    columns = ["k1", "k2", "words", "len"]
    own = (turns.join(everyone, "conv_id").where("pos > h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("keep")).alias("pos"), *columns))
    heads = (turns.where((F.col("pos") < most) & (F.col("conv_id") % of == 0)).withColumnRenamed("conv_id", "base")
             .join(everyone, "base").where("pos <= keep").select("conv_id", "pos", *columns))
    return own.unionByName(heads), everyone.select("conv_id")
