"""Documents linked by the Jaccard similarity of their word shingles: a size-aware heavy-light join.

A document's set holds its distinct shingles of `WORDS_PER_SHINGLE` words. Equal sets are one node from
the start. The lists through which nodes meet depend on the size of the sets, so that similar sets share a
list for certain and others hardly ever do:

**Light.** Two sets of sizes a <= b are linked exactly if they have `c = ceil(t (a + b) / (1 + t))` common
elements. So for each pair of sizes, both sets list all their subsets of size c: small sets have few, as only one
or two elements may be left out. A shared subset is a link.

**Heavy.** For large sets the number of subsets explodes. Their elements are dealt by hash into groups, more of
them than a linked pair can have differing elements (at most `(1 - t) / (1 + t)` of both sizes). A
differing element spoils one group, so linked sets have a group with equal content, and the inverted list of
that group holds both. Groups of no element are not listed: there are `SPARE` groups more, and a set with
more empty groups than that lists these, too. Sizes are divided into classes so that a partner
is in the same or the next class; a set lists the groups of its class and those of the class below.

**The boundary** is the size at which the listed entries of all sets together are fewest, taken from the counts of
the sizes up to `LIGHTEST`. Pairs with a set above the boundary meet in the inverted lists.

Lists are scanned in rounds. First all nodes of a list meet its leader, the node that has most company in
all its lists, then others by chance, until a round finds no link; so a large group of near copies makes a linear
number of pairs. All pairs are checked on the sets themselves. Nodes of one component need not meet
again. Where a list still holds several components, all pairs between them are then compared, in salted
parts. No pair is left out at any size: lists, groups and subsets have no caps.

**Links are counted** when the components are known, as a link has both ends in one: two nodes are linked, and of
larger components all pairs are compared, in blocks of two parts of bounded size. The common elements of all
pairs of a block are one product of matrices, and only a number per node and block leaves it. So rows
grow with the parts of a component, the comparing with the pairs that it has, which are what is counted.

Words are maximal runs of characters other than the ASCII white space 9 to 13 and 32, with A-Z in lower case.

- A null text and one without words have the empty set: 0 shingles, no link, a component of their own.
- Fewer words than a shingle needs are one shingle, all of them.
- `component_id` is the smallest `doc_id` of the component, null where all are null; `n_links` counts all other
  documents that are linked with the document, equal sets included.
- Repeated rows are linked; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.llm.common import HEAVY_KEYS, HEAVY_ROWS, join_by_weight, located
from linecensus.llm.near_dedup import components, mixed
from linecensus.session import write_table

WORDS_PER_SHINGLE = 3
# Similarity in hundredths.
THRESHOLD = 90
# Largest size that can be light.
LIGHTEST = 64
# Groups beyond those that differing elements can spoil.
SPARE = 2
# What a check costs for each element, in listed entries.
CHECK_COST = 0.1
# Leaders of a list after the first round.
LEADERS = 3
# Nodes of an open list that one key of the last join holds, and of a component that a part holds.
PART = 512
# Elements that the sets of a part hold together, and different ones of a block that are multiplied at once.
PART_ELEMENTS, MULTIPLIED = 1 << 20, 1 << 12
# Words of 64 bits with the parity of the elements of each bit.
PARITY = 8
# Documents whose sets are made together, bytes of a text that are split together, words remembered.
_BATCH, _BYTES, _REMEMBERED = 200, 1 << 20, 200_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_WAYS = [f"w{i}" for i in range(PARITY)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    data = (text or "").encode("utf-8", "replace")
    parts, start = [], 0
    while start < len(data):
        space = _SPACE.search(data, start + _BYTES)
        end = space.start() if space else len(data)
        # Bytes know ASCII only: other letters keep their case, other white space joins words.
        words = data[start:end].lower().split()
        parts.append(np.fromiter(map(_HASHES.__getitem__, words), _U, len(words)))
        start = end
    words = np.concatenate(parts) if parts else np.zeros(0, _U)
    if not len(words):
        return words
    size = min(WORDS_PER_SHINGLE, len(words))
    total = np.full(len(words) - size + 1, size, _U)
    for i in range(size):
        total = mixed(total * _ODD + words[i : i + len(total)])
    return np.unique(total)


def largest_partner(size: int) -> int:
    return 100 * size // THRESHOLD


def common_elements(a: int, b: int) -> int:
    """Common elements that sets of these sizes need to be linked."""
    return -(-THRESHOLD * (a + b) // (100 + THRESHOLD))


def differing_elements(a: int, b: int) -> int:
    """Elements of only one of the two sets that linked sets have at most."""
    return (100 - THRESHOLD) * (a + b) // (100 + THRESHOLD)


def size_classes(largest: int) -> list[int]:
    """First sizes of the classes up to that of `largest`; partners are in one class or in neighbours."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(largest_partner(starts[-1]) + 1)
    return starts


@cache
def class_of(size: int) -> int:
    return len(size_classes(size)) - 2


@cache
def groups_of(size_class: int) -> int:
    """Groups into which the sets are dealt whose smaller partner is of this class."""
    start = 1
    for _ in range(size_class + 1):
        start = largest_partner(start) + 1
    return differing_elements(start - 1, largest_partner(start - 1)) + 1 + SPARE


def group_lists(elements: np.ndarray) -> np.ndarray:
    """Keys of the inverted lists of a set: its groups as the smaller partner, and as the larger."""
    own = class_of(len(elements))
    totals = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(elements))])
    keys = []
    for size_class in range(max(0, own - 1), own + 1):
        groups = groups_of(size_class)
        # Elements are sorted, so the groups are runs of them.
        group = ((elements >> _U(32)) * _U(groups)) >> _U(32)
        edges = np.searchsorted(group, np.arange(groups + 1, dtype=_U))
        sizes = np.diff(edges)
        listed = np.arange(groups, dtype=_U)
        sums = totals[edges[1:]] - totals[edges[:-1]] + sizes.astype(_U)
        if (sizes == 0).sum() <= SPARE:
            listed, sums = listed[sizes > 0], sums[sizes > 0]
        keys.append(mixed(sums * _ODD + mixed(listed + _U(size_class << 32) + _U(1))))
    return np.concatenate(keys)


def subset_lists(elements: np.ndarray, sizes: list[int], boundary: int) -> np.ndarray:
    """Keys of the fixed-size subsets that a light set shares with those of its light partners."""
    own = len(elements)
    values = mixed(elements)
    total = values.sum(dtype=_U)
    keys = []
    for other in sizes:
        a, b = min(own, other), max(own, other)
        if b > boundary or b > largest_partner(a):
            continue
        left_out = own - common_elements(a, b)
        if left_out:
            places = np.array(list(combinations(range(own), left_out)))
            sums = total - values[places].sum(axis=1, dtype=_U)
        else:
            sums = np.array([total])
        keys.append(mixed(sums * _ODD + mixed(np.array([(a << 20) + b + (1 << 60)], _U))))
    return np.concatenate(keys) if keys else np.zeros(0, _U)


def best_boundary(counts: dict[int, int]) -> int:
    """The boundary with the fewest listed entries, for the counts of sets by size (up to LIGHTEST)."""
    sizes = sorted(counts)

    def heavy(size: int) -> float:
        own = class_of(size)
        return sum(groups_of(c) for c in range(max(0, own - 1), own + 1)) + CHECK_COST * size

    def light(size: int, boundary: int) -> int:
        pairs = [(min(size, o), max(size, o)) for o in sizes if o <= boundary]
        return sum(comb(size, size - common_elements(a, b)) for a, b in pairs if b <= largest_partner(a))

    def cost(boundary: int) -> float:
        total = 0.0
        for size in sizes:
            if size <= boundary:
                total += counts[size] * light(size, boundary)
            if largest_partner(size) > boundary:
                total += counts[size] * heavy(size)
        return total

    return min(range(LIGHTEST + 1), key=cost)


def parity(elements: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY bits, whether an odd number of elements falls on it.

    Every differing element of two sets changes one bit, so they differ in no more bits than elements.
    """
    bits = np.bincount((elements & _U(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame) -> DataFrame:
    """`(file, row, doc_id, set_key, size, w0.., lists, light)` of each document.

    `lists` are the inverted lists of sets that are heavy at any boundary, `light` the elements of the others.
    """

    def sets(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for start in range(0, batch.num_rows, _BATCH):
                part = batch.slice(start, _BATCH)
                found = [shingle_set(text.as_py()) for text in part.column("text")]
                ways = np.array([parity(e) for e in found])
                columns = [
                    part.column("file"), part.column("row"), part.column("doc_id"),
                    pa.array([xxhash.xxh128_digest(e.tobytes()) for e in found], pa.binary()),
                    pa.array([len(e) for e in found], pa.int64()),
                    *[pa.array(ways[:, i]) for i in range(PARITY)],
                    pa.array([group_lists(e).view(np.int64) if len(e) > LIGHTEST else None for e in found], pa.list_(pa.int64())),
                    pa.array([e.view(np.int64) if len(e) <= LIGHTEST else None for e in found], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["file", "row", "doc_id", "set_key", "size", *_WAYS, "lists", "light"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ways = ", ".join(f"{way} bigint" for way in _WAYS)
    schema = f"file string, row bigint, doc_id {kind}, set_key binary, size bigint, {ways}, lists array<bigint>, light array<bigint>"
    return _placed(docs).mapInArrow(sets, schema)


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "text"
    )


def _listed(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """`(list, node)`: every entry of the lists of all nodes."""
    counts = nodes.filter(F.col("size") <= LIGHTEST).groupBy("size").count().collect()
    counts = {row["size"]: row["count"] for row in counts}
    boundary, sizes = best_boundary(counts), sorted(counts)

    def light_lists(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, _BATCH):
                part = batch.slice(start, _BATCH)
                found = []
                for elements in part.column("light"):
                    elements = elements.values.to_numpy().view(_U)
                    keys = [subset_lists(elements, sizes, boundary)] if len(elements) <= boundary else []
                    if largest_partner(len(elements)) > boundary:
                        keys.append(group_lists(elements))
                    found.append(np.concatenate(keys).view(np.int64))
                columns = [part.column("node"), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "lists"])

    first = nodes.select("place.*", "node").hint("merge")
    own = signed.select("file", "row", "lists", "light").join(first, ["file", "row"])
    heavy = own.filter("lists IS NOT NULL").select("node", "lists")
    light = own.filter("light IS NOT NULL").select("node", "light").mapInArrow(
        light_lists, "node bigint, lists array<bigint>"
    )
    listed = write_table(heavy.unionByName(light), "node-lists")
    return listed.select(F.explode("lists").alias("list"), "node")


def _open_lists(members: DataFrame) -> DataFrame:
    """The rows `(list, node, component)` of lists that hold several components, written."""
    several = members.groupBy("list").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    several = write_table(several.filter("a <> b").select("list"), "open-lists")
    return write_table(members.join(several.hint("merge"), "list").select("list", "node", "component"), "list-members")


def _led_pairs(members: DataFrame, turn: int) -> DataFrame:
    """`(node, leader)` of different components: the nodes of each list and its leaders."""
    if turn == 0:
        sizes = write_table(members.groupBy("list").agg(F.count("*").alias("company")), "list-sizes")
        company = join_by_weight(members, sizes, ["list"]).groupBy("node").agg(F.sum("company").alias("company"))
        ranked, orders = members.join(company, "node"), [F.struct("company", "node")]
    else:
        ranked, orders = members, [F.xxhash64("node", F.lit(turn), F.lit(i)) for i in range(LEADERS)]
    leader = F.struct(F.col("node").alias("leader"), F.col("component").alias("other"))
    leaders = ranked.groupBy("list").agg(F.array_distinct(F.array(*[F.max_by(leader, o) for o in orders])).alias("leaders"))
    met = join_by_weight(members, write_table(leaders, "list-leaders"), ["list"])
    met = met.select("node", "component", F.explode("leaders").alias("l")).select("node", "component", "l.*")
    return met.filter("component <> other").select("node", "leader").distinct()


def _between(size: str, its: str, ways: list[tuple[str, str]]) -> Column:
    """Whether sizes and parities allow a link."""
    sizes = F.least(size, its) * 100 >= F.greatest(size, its) * THRESHOLD
    bits = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in ways), F.lit(0))
    return sizes & (bits * (100 + THRESHOLD) <= (F.col(size) + F.col(its)) * (100 - THRESHOLD))


def _open_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """`(node, leader)`: all pairs of different components in the lists that can be links."""
    sizes = members.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sized = join_by_weight(members, write_table(sizes, "open-sizes"), ["list"])
    sized = sized.join(nodes.select("node", "size", *_WAYS).hint("merge"), "node")
    sized = write_table(sized, "open-members")
    left = sized.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    right = sized.select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("leader"),
        F.col("component").alias("other"), F.col("size").alias("its"), *[F.col(w).alias(f"its_{w}") for w in _WAYS],
    )
    can_be = _between("size", "its", [(w, f"its_{w}") for w in _WAYS])
    on = [left["list"] == right["list"], left["part"] == right["part"]]
    allowed = (F.col("component") != F.col("other")) & (F.col("node") > F.col("leader")) & can_be
    met = left.hint("merge").join(right, on=reduce(Column.__and__, on) & allowed)
    return met.select("node", "leader").distinct()


def _joined(pairs: DataFrame, of_node: DataFrame, names: list[str]) -> DataFrame:
    """`pairs` with the columns `names` of both nodes, those of the leader named `its_...`.

    A leader of many pairs is there several times, each for a part of its pairs.
    """
    # Fewer than HEAVY_KEYS leaders have more pairs than this.
    common = max(HEAVY_ROWS, pairs.count() // HEAVY_KEYS)
    counts = pairs.groupBy("leader").count().filter(F.col("count") > common)
    counts = write_table(counts.select("leader", F.ceil(F.col("count") / common).alias("copies")), "heavy-leaders")
    counts, copies = F.broadcast(counts), F.coalesce("copies", F.lit(1))
    dealt = pairs.join(counts, "leader", "left").select(
        "node", "leader", F.pmod(F.xxhash64("node"), copies).alias("copy")
    )
    its = of_node.select(F.col("node").alias("leader"), *[F.col(n).alias(f"its_{n}") for n in names])
    its = its.join(pairs.select("leader").distinct().hint("merge"), "leader").join(counts, "leader", "left")
    its = its.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))).drop("copies")
    own = of_node.select("node", *names).hint("merge")
    return dealt.join(its.hint("merge"), ["leader", "copy"]).drop("copy").join(own, "node")


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are links, by their sizes and parities first and then by the sets themselves."""
    pairs = write_table(pairs, "list-pairs")
    possible = _joined(pairs, nodes, ["size", *_WAYS])
    possible = possible.filter(_between("size", "its_size", [(w, f"its_{w}") for w in _WAYS]))
    possible = write_table(possible.select("node", "leader"), "possible-pairs")
    wanted = possible.select("node").unionByName(possible.select(F.col("leader").alias("node"))).distinct()
    wanted = write_table(nodes.join(wanted.hint("merge"), "node").select("node", "place.*"), "paired-places")
    both = _joined(possible, write_table(_elements(wanted, docs), "full-sets"), ["elements"])
    shared = F.size(F.array_intersect("elements", "its_elements")).cast("long")
    total = F.size("elements").cast("long") + F.size("its_elements")
    return write_table(both.filter(shared * (100 + THRESHOLD) >= total * THRESHOLD).select("node", "leader"), "links")


def _elements(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """`(node, elements)`: the sets of the nodes `(node, file, row)`."""
    texts = _placed(docs).join(wanted, ["file", "row"]).select("node", "text")

    def elements(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, _BATCH):
                part = batch.slice(start, _BATCH)
                found = [shingle_set(text.as_py()).view(np.int64) for text in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "elements"]
                )

    return texts.mapInArrow(elements, "node bigint, elements array<bigint>")


def common_counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of `sets` has in common with each of `others`."""
    both = [*sets, *others]
    elements, number, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    # What only one set has is in no intersection.
    column = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])[times[number] > 1]
    column = column[number[times[number] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(others)), np.int64)
    for first in range(0, int((times > 1).sum()), MULTIPLIED):
        here = slice(*np.searchsorted(column, [first, first + MULTIPLIED]))
        matrix = np.zeros((len(both), MULTIPLIED), np.float32)
        matrix[row[here], column[here] - first] = 1
        # Sums of at most MULTIPLIED ones are exact.
        shared += (matrix[: len(sets)] @ matrix[len(sets) :].T).astype(np.int64)
    return shared


def _link_counts(inside: DataFrame, docs: DataFrame) -> DataFrame:
    """`(node, its)`: documents of other nodes that each of the nodes `inside` large components is linked with.

    `inside` has `(node, place, size, copies, component)`. A block holds two parts of a component, or one with itself.
    """
    weight = F.greatest(F.count("*") / PART, F.sum("size") / PART_ELEMENTS)
    sizes = write_table(inside.groupBy("component").agg(F.ceil(weight).cast("int").alias("parts")), "component-parts")
    parted = join_by_weight(inside, sizes, ["component"])
    part = F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")
    parted = write_table(parted.select("node", "place.*", "copies", "component", "parts", part), "component-nodes")
    full = write_table(_elements(parted.select("node", "file", "row"), docs), "component-sets")
    rows = full.join(parted.hint("merge"), "node").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    first, second = F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second")
    rows = rows.select("component", first, second, "part", "node", "copies", "elements")

    def count(table):
        import pyarrow as pa

        part, of = table.column("part").to_numpy(), table.column("first")[0].as_py()
        sets = table.column("elements").combine_chunks()
        edges = sets.offsets.to_numpy()
        values = sets.values.to_numpy()
        sets = [values[start:end] for start, end in zip(edges[:-1], edges[1:])]
        lengths, copies = np.diff(edges).astype(np.int64), table.column("copies").to_numpy()
        a = np.flatnonzero(part == of)
        b = a if len(a) == len(part) else np.flatnonzero(part != of)
        if table.column("second")[0].as_py() != of and b is a or not len(a):
            linked = np.zeros(len(part), np.int64)
        else:
            shared = common_counts([sets[i] for i in a], [sets[i] for i in b])
            links = shared * (100 + THRESHOLD) >= (lengths[a][:, None] + lengths[b]) * THRESHOLD
            linked = np.zeros(len(part), np.int64)
            if b is a:
                np.fill_diagonal(links, False)
            else:
                linked[b] = copies[a] @ links
            linked[a] = links @ copies[b]
        return pa.table({"node": table.column("node"), "its": pa.array(linked)})

    counted = rows.groupBy("component", "first", "second").applyInArrow(count, "node bigint, its bigint")
    return counted.groupBy("node").agg(F.sum("its").alias("its"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`(node, component)` after the components at the ends of links are one."""
    of = labels.select(F.col("node").alias("leader"), F.col("component").alias("other"))
    between = links.join(labels, "node").join(of, "leader")
    between = between.select(F.col("component").alias("node"), F.col("other").alias("leader"))
    merged = components(between).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    joined = join_by_weight(labels, write_table(merged, "merged"), ["component"], "left")
    return write_table(joined.select("node", F.coalesce("merged", "component").alias("component")), "labels")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_shingles, component_id, n_links)` of each document."""
    docs = located(docs)
    signed = write_table(_sets(docs), "sets")
    place = F.min(F.struct("file", "row")).alias("place")
    nodes = signed.filter("size > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), place,
        *[F.first(name).alias(name) for name in ("size", *_WAYS)],
    )
    nodes = write_table(nodes.withColumn("node", F.monotonically_increasing_id()), "set-nodes")
    entries = _listed(signed, nodes).withColumn("component", F.col("node"))
    members = _open_lists(entries)
    labels = write_table(members.select("node", "component").distinct(), "labels")
    shared = write_table(nodes.join(labels.select("node").hint("merge"), "node"), "shared-nodes")
    turn, complete = 0, False
    while not complete and not members.isEmpty():
        links = _links(_led_pairs(members, turn), shared, docs)
        complete = links.isEmpty()
        if complete:
            # Leaders find no more: all pairs that are left are compared.
            links = _links(_open_pairs(members, shared), shared, docs)
            if links.isEmpty():
                break
        labels = _relabelled(labels, links)
        if not complete:
            members = _open_lists(members.select("list", "node").join(labels, "node"))
        turn += 1
    return _documents(signed, nodes, labels, docs)


def _documents(signed: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    named = nodes.select("node", "set_key", "rep", "copies", "size", "place").join(labels.hint("merge"), "node", "left")
    named = write_table(named.withColumn("component", F.coalesce("component", "node")), "named-nodes")
    whole = [F.min("rep").alias("component_id"), F.count("*").alias("sets"), F.sum("copies").alias("documents")]
    whole = write_table(named.groupBy("component").agg(*whole), "component-ids")
    named = write_table(join_by_weight(named, whole, ["component"]), "component-members")
    inside = write_table(named.filter("sets > 2").select("node", "place", "size", "copies", "component"), "inside")
    linked = write_table(_link_counts(inside, docs), "link-counts")
    # The two sets of a component are linked, so all its documents are.
    its = F.coalesce("its", F.col("documents") - F.col("copies"))
    result = named.join(linked.hint("merge"), "node", "left").select(
        "set_key", "component_id", (F.col("copies") - 1 + its).alias("n_links")
    )
    result = write_table(result, "set-results")
    rows = signed.select("doc_id", F.col("size").alias("n_shingles"), "set_key")
    some = join_by_weight(rows.filter("n_shingles > 0"), result, ["set_key"]).drop("set_key")
    none = rows.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return some.unionByName(none)


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of similar word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
