"""Prefix trie of conversations, rolled up by centroid decomposition.

**Rebuilding.** Every conversation c takes its first turns from conversation `c - c % 100`: as many as
the checksum of its number says, then its own turns after that place. Turns are numbered in range parts of
(conversation, turn), each with the count of the parts before it, so that a conversation of any length
is no single task.

**Nodes.** A turn at its place is two 64-bit hashes; a prefix is their exclusive-or over its turns, which
is found by running totals inside the parts and those of the parts before. Equal prefixes are one node, named by
its smallest member and its depth: the path of that conversation runs through it.

**Rollup.** Sums over subtrees come from a centroid decomposition of the forest of parent edges below
the root. The weight of a node is the number of its members, so the weight of a subtree is known from the
node's members alone: the turns they have from there on. In every component the nodes that hold
more than half of its weight are one path down from the top; the last of them is the centroid. The total
below it is aggregated once and added to every node of that path, whose weights lose the centroid's.
Then the component falls apart into the subtrees under the centroid and the part above, each of at most
half its weight, and so on. Components of more than `LOCAL` nodes are split by joins, all at once in every
round, and are known to all tasks by one row each; the smaller ones are finished in a
task, many together. Chains of any depth and nodes with any number of children take the same number of rounds.

**Ends.** The members that end at a node are sorted over range parts and joined into pieces of text there; the
digest reads a node's pieces one after another and never holds them all.

- Rows without a `conv_id` belong to no conversation and go. A null role or text is empty.
- Turns of equal number are in the order of role and of a hash of role and text; a repeated row is one more turn.
- A conversation without turns of its own left, or whose root conversation is absent, is shorter; without any
  turn it ends at the root.
- Other columns are ignored; an empty table gives an empty result, without a root.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecensus.llm.common import join_by_weight, text_or_empty
from linecensus.session import write_table

# Conversations that share their first turns, and the most turns that are shared, plus one.
FAMILY, TURNS = 100, 6
# Nodes up to which a component is finished in one task.
LOCAL = 20_000
# Rows of small components that are worked on together.
BLOCK = 50_000
# Characters of a piece of a node's list of members.
PIECE = 1 << 16

KEY, COMPONENT = ["k1", "k2"], ["c1", "c2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """`(part, conv_id, place, h1, h2, size)`: own turns from 1 on, hashed, in range parts."""
    role, text = text_or_empty("role"), text_or_empty("text")
    cut = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role).alias("h2"),
        F.char_length(text).cast("long").alias("size"),
        # Equal rows, of which there may be many, are dealt over several parts.
        F.monotonically_increasing_id().alias("nth"),
    )
    order = [F.asc_nulls_first("turn"), "role", "h1", "h2", "nth"]
    parts = cut.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    parts = write_table(parts, "turn-parts")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("part", "conv_id").count()
    counts = counts.select("part", "conv_id", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))
    placed = parts.withColumn("inside", inside).join(counts, ["part", "conv_id"])
    placed = placed.select("part", "conv_id", (F.col("before") + F.col("inside")).alias("place"), "h1", "h2", "size")
    return write_table(placed, "turns")


def rebuilt_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: `(conv_id, turns)`, and a row for each prefix of each.

    A prefix is `(conv_id, depth, k1, k2, p1, p2, c1, c2, turns, size)`: the keys of its node, of the
    parent and of the first turn's node, the turns of the conversation, and the size of its last text.
    """
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < TURNS)).groupBy(
        F.col("conv_id").alias("head")
    ).agg(F.sort_array(F.collect_list(F.struct("place", "h1", "h2", "size"))).alias("first"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS).cast("int")
    firsts = turns.groupBy("conv_id").agg(F.min("part").alias("first_part")).select(
        "*", shared.alias("shared"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head")
    )
    firsts = firsts.join(heads, "head", "left")
    taken = F.slice("first", 1, F.col("shared")).alias("first")
    firsts = write_table(firsts.select("conv_id", "first_part", "shared", taken), "first-turns")
    taken_turns = F.when(F.col("first").isNull(), 0).otherwise(F.size("first")).alias("taken")
    # The turns that a conversation lies in many parts with meet one row for each of these parts.
    spread = turns.select("part", "conv_id").distinct().join(
        firsts.select("conv_id", "shared", taken_turns), "conv_id"
    )
    own = turns.join(spread, ["part", "conv_id"]).filter("place > shared").select(
        "part", "conv_id", (F.col("place") - F.col("shared") + F.col("taken")).alias("depth"), "h1", "h2", "size"
    )
    taken_rows = firsts.select(F.col("first_part").alias("part"), "conv_id", F.explode("first").alias("t")).select(
        "part", "conv_id", F.col("t.place").alias("depth"), "t.h1", "t.h2", "t.size"
    )
    rows = own.unionByName(taken_rows).select(
        "part", "conv_id", "depth", "size",
        F.xxhash64("depth", "h1").alias("e1"), F.xxhash64("depth", "h2").alias("e2"),
    )
    rows = write_table(rows, "rebuilt-turns")
    of_part = rows.groupBy("part", "conv_id").agg(
        F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"), F.max("depth").alias("last"),
        *[F.max(F.when(F.col("depth") == 1, F.col(e))).alias(c) for e, c in zip(("e1", "e2"), COMPONENT)],
    )
    conversation = Window.partitionBy("conv_id")
    earlier = conversation.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = of_part.select(
        "part", "conv_id",
        *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("x1", "x2")],
        F.max("last").over(conversation).alias("turns"),
        *[F.max(c).over(conversation).alias(c) for c in COMPONENT],
    )
    inside = Window.partitionBy("part", "conv_id").orderBy("depth")
    running = rows.select("*", *[F.bit_xor(e).over(inside).alias(r) for e, r in (("e1", "r1"), ("e2", "r2"))])
    joined = running.join(carried, ["part", "conv_id"])
    keys = [F.col(r).bitwiseXOR(F.col(x)).alias(k) for r, x, k in (("r1", "x1", "k1"), ("r2", "x2", "k2"))]
    paths = joined.select("conv_id", "depth", *keys, "e1", "e2", *COMPONENT, "turns", "size")
    parents = [F.col(k).bitwiseXOR(F.col(e)).alias(p) for k, e, p in (("k1", "e1", "p1"), ("k2", "e2", "p2"))]
    paths = write_table(paths.select("*", *parents).drop("e1", "e2"), "paths")
    lengths = paths.groupBy("conv_id").agg(F.max("turns").alias("turns"))
    every = firsts.select("conv_id").join(lengths, "conv_id", "left")
    return write_table(every.select("conv_id", F.coalesce("turns", F.lit(0)).alias("turns")), "lengths"), paths


def trie_nodes(lengths: DataFrame, paths: DataFrame) -> DataFrame:
    """One row for each node, the root included, with its members, children, parent and weight."""
    weight = F.sum(F.col("turns") - F.col("depth") + 1).alias("weight")
    firsts = [F.min(name).alias(name) for name in ("size", "p1", "p2", *COMPONENT)]
    nodes = paths.groupBy(*KEY, "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), weight, *firsts
    )
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zeros = [F.lit(0).cast("long").alias(name) for name in (*KEY, "depth", "size", "weight")]
    nulls = [F.lit(None).cast("long").alias(name) for name in ("p1", "p2", *COMPONENT)]
    nodes = write_table(nodes.unionByName(root.select("conv_id", "n_convs", *zeros, *nulls)), "nodes")
    below = nodes.filter("depth > 0")
    children = below.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = write_table(counted, "counted-nodes")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = join_by_weight(write_table(counted.filter("depth > 0"), "children"), parents, ["p1", "p2"])
    top = counted.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return write_table(named.unionByName(top), "trie")


def _settled(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "depth", "n_leaves", "saved_tokens")


def rolled_up(trie: DataFrame, paths: DataFrame, local: int = LOCAL) -> DataFrame:
    """`(conv_id, depth, n_leaves, saved_tokens)` of all nodes but the root."""
    saved = ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    rows = trie.filter("depth > 0").select(
        "conv_id", "depth", "parent_conv_id", *COMPONENT, "weight",
        (F.col("n_children") == 0).cast("long").alias("leaf"), saved,
        *[F.lit(0).cast("long").alias(name) for name in ("n_leaves", "saved_tokens")],
    )
    rows = write_table(rows, "rollup")
    ways, settled, small = None, [], []
    while True:
        components = rows.groupBy(*COMPONENT).agg(F.count("*").alias("nodes"), F.max("weight").alias("total"))
        # At most one row for `local` nodes.
        large = write_table(components.filter(F.col("nodes") > local).drop("nodes"), "large-components")
        if large.isEmpty():
            break
        if ways is None:
            ways = write_table(_ways(trie, paths), "ways")
        small.append(rows.join(F.broadcast(large), COMPONENT, "left_anti"))
        rows, done = _split(rows.join(F.broadcast(large), COMPONENT), ways)
        settled.append(done)
    rest = reduce(DataFrame.unionByName, [*small, rows])
    return reduce(DataFrame.unionByName, [*settled, _finished(rest)])


def _ways(trie: DataFrame, paths: DataFrame) -> DataFrame:
    """`(conv_id, depth, at, above)`: the node at each place of the conversations that nodes are named by.

    `at` names the node there, `above` its parent.
    """
    named_by = trie.filter("depth > 0").select("conv_id").distinct()
    along = write_table(paths.join(named_by.hint("merge"), "conv_id").select("conv_id", "depth", *KEY), "ways-along")
    nodes = trie.filter("depth > 0").select(*KEY, F.col("conv_id").alias("at"), F.col("parent_conv_id").alias("above"))
    return join_by_weight(along, nodes, KEY).select("conv_id", "depth", "at", "above")


def _split(rows: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All components cut at their centroids: the rows that remain, and the centroids with their sums."""
    on_path = F.col("weight") * 2 > F.col("total")
    centroids = rows.filter(on_path).groupBy(*COMPONENT).agg(
        F.max_by("conv_id", "depth").alias("centre"), F.max("depth").alias("level"), F.min("weight").alias("cut")
    )
    centroids = write_table(centroids, "centroids")
    rows = write_table(rows.join(F.broadcast(centroids), COMPONENT), "centred-rows")
    # A node is below the centroid if the path to it runs through: its conversation says so, one step deeper.
    deeper = rows.filter("depth > level").select(*COMPONENT, "conv_id", (F.col("level") + 1).alias("step"), "centre")
    deeper = write_table(deeper.distinct(), "deeper-paths")
    steps = ways.withColumnRenamed("depth", "step")
    below = join_by_weight(deeper, steps, ["conv_id", "step"]).filter("above = centre")
    below = write_table(below.select(*COMPONENT, "conv_id", F.col("at").alias("child")), "paths-below")
    rows = join_by_weight(rows, below, [*COMPONENT, "conv_id"], "left")
    inside = F.col("child").isNotNull() & (F.col("depth") > F.col("level"))
    is_centroid = (F.col("conv_id") == F.col("centre")) & (F.col("depth") == F.col("level"))
    rows = write_table(rows.withColumn("inside", inside).withColumn("is_centroid", is_centroid), "parted-rows")
    totals = rows.filter("inside OR is_centroid").groupBy(*COMPONENT).agg(
        F.sum("leaf").alias("sum_leaf"), F.sum("saved").alias("sum_saved")
    )
    totals = write_table(totals, "component-totals")
    rows = rows.join(F.broadcast(totals), COMPONENT)

    def added(name: str, total: str) -> Column:
        return F.when(on_path, F.col(name) + F.col(total)).otherwise(F.col(name)).alias(name)

    rows = rows.select(
        "conv_id", "depth", "parent_conv_id", "is_centroid", "leaf", "saved",
        F.when(F.col("inside"), F.col("child")).otherwise(F.col("c1")).alias("c1"),
        F.when(F.col("inside"), F.col("level") + 1).otherwise(F.col("c2")).alias("c2"),
        F.when(on_path, F.col("weight") - F.col("cut")).otherwise(F.col("weight")).alias("weight"),
        added("n_leaves", "sum_leaf"), added("saved_tokens", "sum_saved"),
    )
    rows = write_table(rows, "rollup")
    return rows.filter(~F.col("is_centroid")).drop("is_centroid"), _settled(rows.filter("is_centroid"))


def _finished(rows: DataFrame) -> DataFrame:
    """The sums of the nodes of small components."""

    def finish(batches):
        import pyarrow as pa

        for block in _whole_components(batches):
            leaves, saved = centroid_sums(block)
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": block["conv_id"], "depth": block["depth"],
                    "n_leaves": block["n_leaves"] + leaves, "saved_tokens": block["saved_tokens"] + saved,
                }
            )

    dealt = rows.repartition(*COMPONENT).sortWithinPartitions(*COMPONENT)
    return dealt.mapInArrow(finish, "conv_id bigint, depth bigint, n_leaves bigint, saved_tokens bigint")


def _whole_components(batches) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of rows sorted by component; none is cut through a component."""
    kept: dict[str, np.ndarray] = {}
    for batch in batches:
        rows = {name: batch.column(name).to_numpy() for name in batch.schema.names}
        kept = {name: np.concatenate([kept[name], rows[name]]) for name in rows} if kept else rows
        if len(kept["c1"]) < BLOCK:
            continue
        starts = np.flatnonzero((np.diff(kept["c1"]) != 0) | (np.diff(kept["c2"]) != 0)) + 1
        if len(starts):
            yield {name: values[: starts[-1]] for name, values in kept.items()}
            kept = {name: values[starts[-1] :] for name, values in kept.items()}
    if kept and len(kept["c1"]):
        yield kept


def centroid_sums(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of `leaf` and `saved` over the part of each node's subtree in its component."""
    n = len(rows["c1"])
    edges = (rows["c1"][1:] != rows["c1"][:-1]) | (rows["c2"][1:] != rows["c2"][:-1])
    component = np.r_[0, np.cumsum(edges)]
    place = {node: i for i, node in enumerate(zip(rows["conv_id"].tolist(), rows["depth"].tolist()))}
    parents = zip(rows["parent_conv_id"].tolist(), (rows["depth"] - 1).tolist())
    own = np.arange(n)
    parent = np.fromiter((place.get(node, i) for i, node in enumerate(parents)), np.int64, n)
    # The parent of a top is in no component, or in another one.
    parent = np.where(component[parent] == component, parent, own)
    weight, depth = rows["weight"].astype(np.int64), rows["depth"]
    values = np.stack([rows["leaf"], rows["saved"]]).astype(np.int64)
    sums = np.zeros((2, n), np.int64)
    open_ = np.ones(n, bool)
    while open_.any():
        # Every node meets the top of its component by pointers of doubling length.
        top = parent
        while True:
            further = top[top]
            if (further == top).all():
                break
            top = further
        path = np.flatnonzero(open_ & (weight * 2 > weight[top]))
        path = path[np.argsort(depth[path], kind="stable")]
        centre = np.full(n, -1)
        centre[top[path]] = path  # the deepest is written last
        of_path = centre[top[path]]
        centre = centre[centre >= 0]
        # Cut above and below the centroids; a total is that of the centroid and the subtrees under it.
        cut = parent.copy()
        cut[centre] = centre
        at = cut
        while True:
            further = at[at]
            if (further == at).all():
                break
            at = further
        totals = np.zeros((2, n), np.int64)
        for row, value in zip(totals, values):
            np.add.at(row, at[open_], value[open_])
        sums[:, path] += totals[:, of_path]
        weight[path] -= weight[of_path].copy()
        values[:, centre] = 0
        open_[centre] = False
        is_centre = np.zeros(n, bool)
        is_centre[centre] = True
        parent = np.where(is_centre[parent] | is_centre, own, parent)
    return sums[0], sums[1]


def ends_digests(lengths: DataFrame, paths: DataFrame) -> DataFrame:
    """`(k1, k2, ends_sha256)` of the nodes at which conversations end."""
    ends = paths.filter("depth = turns").select(*KEY, "conv_id")
    zeros = [F.lit(0).cast("long").alias(name) for name in KEY]
    ends = ends.unionByName(lengths.filter("turns = 0").select(*zeros, "conv_id"))

    def pieces(batches):
        import pyarrow as pa

        node, first, members, size = None, None, [], 0
        for batch in batches:
            found = []
            for k1, k2, member in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (k1, k2) != node or size >= PIECE:
                    if node is not None:
                        found.append((*node, first, ",".join(members)))
                    node, first, members, size = (k1, k2), member, [], 0
                members.append(str(member))
                size += len(members[-1]) + 1
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("k1", "k2", "first", "members"), row)) for row in found], schema=pieces_schema
            )
        if node is not None:
            row = dict(zip(("k1", "k2", "first", "members"), (*node, first, ",".join(members))))
            yield pa.RecordBatch.from_pylist([row], schema=pieces_schema)

    def digest(batches):
        import hashlib

        import pyarrow as pa

        node, state = None, None
        names = ("k1", "k2", "ends_sha256")
        for batch in batches:
            found = []
            for k1, k2, _, members in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (k1, k2) != node:
                    if node is not None:
                        found.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256(members.encode())
                else:
                    state.update(f",{members}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in found], schema=digest_schema)
        if node is not None:
            row = dict(zip(names, (*node, state.hexdigest())))
            yield pa.RecordBatch.from_pylist([row], schema=digest_schema)

    import pyarrow as pa

    keys = [("k1", pa.int64()), ("k2", pa.int64())]
    pieces_schema = pa.schema([*keys, ("first", pa.int64()), ("members", pa.string())])
    digest_schema = pa.schema([*keys, ("ends_sha256", pa.string())])
    ranged = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    cut = ranged.mapInArrow(pieces, "k1 bigint, k2 bigint, first bigint, members string")
    dealt = cut.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return dealt.mapInArrow(digest, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    lengths, paths = rebuilt_paths(numbered_turns(conversations))
    trie = trie_nodes(lengths, paths)
    sums = write_table(rolled_up(trie, paths, local), "subtree-sums")
    # The root is the top of all; its name is the smallest of all.
    whole = trie.agg(
        F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        F.sum((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
    )
    sums = sums.unionByName(whole.filter("conv_id IS NOT NULL"))
    empty = F.sha2(F.lit(""), 256)
    found = trie.join(sums.hint("merge"), ["conv_id", "depth"]).join(ends_digests(lengths, paths), KEY, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations with its counts and subtree sums."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
