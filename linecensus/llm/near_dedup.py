"""Near-duplicate classes with dart minwise signatures.

A document is the set of its five-word shingles (or, weighted, their counts). For every element the
plane of weight and rank is cut into cells of area one; hashes give each cell its darts, the same
in every document. The darts of a document are those whose weight is below the element's and whose
rank is below a bound that yields `k ln k + 2k` of them; every dart belongs to one of the `k`
coordinates, and a coordinate keeps its earliest dart. Two documents agree in a coordinate with
the probability of their (weighted) Jaccard similarity. A document with an empty coordinate is thrown again
with twice the bound; earlier darts stay the same, so signatures never depend on the bound.

Coordinates are joined in bands. In every bucket of a band, members are first paired with leaders only, so
a bucket of any size gives a linear number of pairs. The first leader is the node that meets most
others in all its buckets: in a large group one near its middle. Pairs whose signatures agree in
fewer than `AGREEMENT` of the coordinates go (at similarity 0.8 with probability 2e-8); the others are checked on
the full shingles. Documents of one component need no further pairs: the next round pairs `LEADERS`
leaders of each bucket that still holds several components with the members of others, and so on until a round
finds no link. A pair at similarity 0.8 shares no bucket with probability 2e-5.

The buckets that then still hold several components are compared completely. Up to `COMPLETE` nodes, every
pair of different components is taken. The nodes of larger ones are joined on the elements themselves: with
the elements of each set in one order, rare ones first, two sets of the wanted similarity share one of
their first few (how many depends on both sizes, so sets are keyed by bands of size as well). Elements
that only one component has come before all others and are never joined.

Documents of equal shingle sets are one node from the start. Words are runs of letters, digits and
underscores in lower case.

- A null text counts as empty; texts without words are one class.
- A text of fewer than five words has one shingle, all its words.
- `class_id` is the smallest `doc_id` of the class; null where all of them are null.
- Repeated rows are in one class; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.llm.token_counts import blocks
from linecensus.session import write_table

WORDS_PER_SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6
COORDINATES = BANDS * ROWS
# Leaders per bucket after the first round.
LEADERS = 6
# Nodes up to which an open bucket is compared pair by pair.
COMPLETE = 16
# Ratio of the largest to the smallest size of a band of set sizes.
SIZE_RATIO = 1.05
AGREEMENT = 0.65
WORDS = re.compile(r"\w+")
# Distinct words whose hashes a Python worker remembers.
REMEMBERED = 200_000
# Cells whose darts are thrown together, and elements of documents that are signed together.
_CELLS, _ELEMENTS = 200_000, 300_000
_POISSON = np.cumsum([np.exp(-1.0)] + [np.exp(-1.0) / np.prod(np.arange(1.0, n + 1)) for n in range(1, 20)])
_U = np.uint64


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return value


_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of `x`."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of all shingles of a text, in order, with repetitions."""
    parts = []
    for block in blocks((text or "").lower()):
        words = WORDS.findall(block)
        parts.append(np.fromiter(map(_HASHES.__getitem__, words), _U, len(words)))
    words = np.concatenate(parts) if parts else np.zeros(0, _U)
    if not len(words):
        return words
    size = min(WORDS_PER_SHINGLE, len(words))
    total = np.zeros(len(words) - size + 1, _U)
    for i in range(size):
        total = total * _U(0x9E3779B97F4A7C15) + words[i : i + len(total)]
    return mixed(total + _U(size))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def dart_signatures(
    elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, documents: int, k: int = COORDINATES
) -> np.ndarray:
    """Signatures (documents x k) of weighted sets given as rows `(owner, element, weight)`.

    An entry holds the rank and, in its low bits, the identity of the earliest dart. A document
    without weight keeps the largest value in every coordinate.
    """
    none = np.iinfo(np.uint64).max
    result = np.full((documents, k), none, _U)
    mass = np.bincount(owner, weights, documents)
    darts = k * log(max(2, k)) + 2 * k
    todo = np.flatnonzero(mass > 0)
    while len(todo):
        bound = np.zeros(documents)
        bound[todo] = darts / mass[todo]
        chosen = np.flatnonzero(bound[owner] > 0)
        lowest = np.full(documents * k, none, _U)
        parts = np.cumsum(np.ceil(bound[owner[chosen]])) // _CELLS
        for part in np.split(chosen, np.flatnonzero(np.diff(parts)) + 1):
            _throw(elements[part], weights[part], owner[part], bound, k, lowest)
        result[todo] = lowest.reshape(documents, k)[todo]
        todo = todo[(result[todo] == none).any(axis=1)]
        darts *= 2
    return result


def _throw(elements, weights, owner, bound, k, lowest) -> None:
    """Darts of the rows, kept in `lowest` (documents * k) where they are the earliest."""
    level = 0
    while len(elements):
        # Level: weights from 2^level - 1 on, 2^level wide; cells of rank are 2^-level high.
        width = float(2**level)
        cells = np.ceil(bound[owner] * width).astype(np.int64)
        row = np.repeat(np.arange(len(elements)), cells)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = mixed(mixed(elements[row] + _U(level + 1)) + cell.astype(_U))
        count = np.searchsorted(_POISSON, _uniform(seed), "right")
        dart = np.repeat(np.arange(len(row)), count)
        number = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
        seed = mixed(seed[dart] + (number + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
        row, cell = row[dart], cell[dart]
        rank = (cell + _uniform(seed)) / width
        place = mixed(seed + _U(1))
        weight = width - 1 + _uniform(place) * width
        inside = (rank < bound[owner[row]]) & (weight < weights[row])
        seed, rank, row = mixed(place + _U(2))[inside], rank[inside], row[inside]
        coordinate = (seed >> _U(32)) % _U(k)
        value = (rank * 2.0**32).astype(_U) << _U(16) | seed & _U(0xFFFF)
        np.minimum.at(lowest, owner[row] * k + coordinate.astype(np.int64), value)
        level += 1
        more = weights > 2**level - 1
        elements, weights, owner = elements[more], weights[more], owner[more]


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One bucket key per band; keys of different bands differ."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), rows.shape[:2])
    for i in range(ROWS):
        keys = mixed(keys * _U(0x9E3779B97F4A7C15) + rows[:, :, i])
    return keys.astype(np.int64)


def _sets(texts, weighted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text in texts:
        found = shingles(text.as_py())
        if weighted:
            elements, counts = np.unique(found, return_counts=True)
            yield elements, counts.astype(np.float64)
        else:
            found.sort()
            elements = found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found
            yield elements, np.ones(len(elements))


def signatures(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """`(doc_id, set_key, mass, bands, sketch)` of each document.

    They are a 128-bit digest of the (weighted) set, its total weight, its bucket keys and 16 bits of
    each coordinate.
    """

    def sign(batches):
        import pyarrow as pa

        def signed(block, ids):
            elements = np.concatenate([e for e, _ in block])
            weights = np.concatenate([w for _, w in block])
            owner = np.repeat(np.arange(len(block)), [len(e) for e, _ in block])
            keys = [_digest(*pair) for pair in block]
            mass = pa.array([int(w.sum()) for _, w in block], pa.int64())
            found = dart_signatures(elements, weights, owner, len(block))
            rows = band_keys(found), (mixed(found) >> _U(48)).astype(np.uint16).view(np.int16)
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())
                )
                for x in rows
            ]
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(keys, pa.binary()), mass, *lists],
                ["doc_id", "set_key", "mass", "bands", "sketch"],
            )

        for batch in batches:
            ids, block, size, first = batch.column("doc_id"), [], 0, 0
            for i, pair in enumerate(_sets(batch.column("text"), weighted)):
                block.append(pair)
                size += len(pair[0]) + COORDINATES
                if size >= _ELEMENTS:
                    yield signed(block, ids.slice(first, len(block)))
                    block, size, first = [], 0, i + 1
            if block:
                yield signed(block, ids.slice(first, len(block)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, set_key binary, mass bigint, bands array<bigint>, sketch array<smallint>"
    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """`(set_key, elements)` of each document; weighted, an element occurs once for every count."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                block = list(_sets(batch.column("text").slice(start, 200), weighted))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_digest(*pair) for pair in block], pa.binary()),
                        pa.array([_occurrences(*pair) for pair in block], pa.list_(pa.int64())),
                    ],
                    ["set_key", "elements"],
                )

    return docs.select("text").mapInArrow(cut, "set_key binary, elements array<bigint>")


def _digest(elements: np.ndarray, weights: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(elements.tobytes() + weights.tobytes())


def _occurrences(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One number for each occurrence: the Jaccard similarity of counts is that of these sets."""
    times = weights.astype(np.int64)
    every = np.repeat(elements, times)
    nth = np.arange(len(every)) - np.repeat(np.cumsum(times) - times, times)
    return (every + nth.astype(_U) * _U(0x9E3779B97F4A7C15)).astype(np.int64)


def _bucket_pairs(members: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """`(node, leader)` of different components in one bucket whose signatures agree enough.

    `members` is `(bucket, node, component)`. Leaders after the first are taken by chance, but in the
    same order everywhere, so a node meets few different ones in all its buckets.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    met = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("met"))
    chance = [F.xxhash64("node", F.lit(turn), F.lit(i)) for i in range(LEADERS if turn else 1)]
    orders = [F.col("met") + F.pmod(chance[0], F.lit(1 << 20)) / (1 << 20), *chance[1:]]
    firsts = F.arrays_zip(
        F.array(*[F.max_by("node", order) for order in orders]).alias("leader"),
        F.array(*[F.max_by("component", order) for order in orders]).alias("component"),
    )
    leaders = members.join(met, "node").groupBy("bucket").agg(firsts.cast(_LEADER).alias("firsts"))
    leaders = write_table(leaders, "bucket-leaders")
    others = F.filter("firsts", lambda first: first["component"] != F.col("component"))
    # At most BANDS * LEADERS leaders of a node.
    of_node = members.join(leaders, "bucket").groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_list(F.transform(others, lambda first: first["leader"])))).alias("all")
    )
    return _agreeing(of_node.select("node", F.explode("all").alias("leader")), sets)


def _agreeing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of similar size whose signatures agree enough."""
    # A merge join at every size; sketches are many and wide where pairs are many.
    sketches = sets.select("node", "sketch", "mass").hint("merge")
    its = sketches.select(
        F.col("node").alias("leader"), F.col("sketch").alias("its"), F.col("mass").alias("its_mass")
    )
    same = F.zip_with("sketch", "its", lambda a, b: (a == b).cast("int"))
    agreed = F.aggregate(same, F.lit(0), lambda total, one: total + one)
    both = pairs.join(sketches, "node").join(its, "leader")
    # Similar sets are of similar size.
    sizes = F.least("mass", "its_mass") >= SIMILARITY * F.greatest("mass", "its_mass") - 1e-9
    return both.filter(sizes & (agreed >= int(AGREEMENT * COORDINATES))).select("node", "leader")


_LEADER = "array<struct<leader:bigint,component:bigint>>"


def _between_components(members: DataFrame) -> DataFrame:
    """The rows `(bucket, node, component)` of the buckets that hold several components, written."""
    several = members.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    several = write_table(several.filter("a <> b").select("bucket"), "open-buckets")
    # A merge join at every size: the buckets are many where the members are.
    return write_table(members.join(several.hint("merge"), "bucket").select("bucket", "node", "component"), "members")


def _full_sets(nodes: DataFrame, docs: DataFrame, sets: DataFrame, weighted: bool, turn: int) -> DataFrame:
    """`nodes` with the `elements` of each, written.

    The sets are made again from one document of each. In the first round, where they are many, texts
    are moved by their identifier in a merge join at every size; later the sizes decide.
    """
    wanted = write_table(nodes.join(sets.select("node", "set_key", "rep"), "node"), "paired-sets")
    # Written alone, so that its own size decides about the join.
    reps = write_table(wanted.select("rep").distinct(), "paired-reps")
    reps = reps if turn else reps.hint("merge")
    texts = docs.select("doc_id", "text").join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    # Several documents without an identifier, or with the same one, may give other sets, or one twice.
    full = shingle_sets(texts, weighted).join(wanted.hint("merge"), "set_key")
    return write_table(full.select(*nodes.columns, "elements"), "shingle-sets")


def _needed(a: Column, b: Column) -> Column:
    """Common elements that sets of these sizes need for the threshold."""
    return F.ceil((SIMILARITY * (a + b) - 1e-6) / (1 + SIMILARITY))


def _complete_pairs(members: DataFrame, docs: DataFrame, sets: DataFrame, weighted: bool, turn: int) -> DataFrame:
    """`(node, leader)` of different components that can be links, of all pairs in the buckets of `members`."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    sized = write_table(members.join(sizes, "bucket"), "sized-members")
    few = sized.filter(F.col("size") <= COMPLETE)
    others = few.select("bucket", F.col("node").alias("leader"), F.col("component").alias("other"))
    both = few.join(others.hint("merge"), "bucket")
    close = both.filter("node > leader AND component <> other").select("node", "leader").distinct()
    many = sized.filter(F.col("size") > COMPLETE).select("node", "component").distinct()
    pairs = write_table(close, "close-pairs")
    many = write_table(many, "crowded-nodes")
    if not many.isEmpty():
        crowded = _prefix_pairs(_full_sets(many, docs, sets, weighted, turn))
        pairs = pairs.unionByName(crowded).distinct()
    return _agreeing(pairs, sets)


def _prefix_pairs(full: DataFrame) -> DataFrame:
    """`(node, leader)` of different components of `(node, component, elements)` that can reach the threshold.

    The first common element of a pair, in the order of elements, has enough elements behind it in both
    sets; pairs without such an element are left out, all others are returned.
    """
    each = full.select("node", "component", F.size("elements").alias("size"), F.explode("elements").alias("element"))
    common = each.groupBy("element").agg(
        F.count("*").alias("times"), F.min("component").alias("a"), F.max("component").alias("b")
    )
    common = write_table(common.filter("a <> b").select("element", "times"), "common-elements")
    ordered = each.join(common.hint("merge"), "element").groupBy("node", "component", "size").agg(
        F.sort_array(F.collect_list(F.struct("times", "element"))).alias("ordered")
    )
    alone = F.col("size") - F.size("ordered")
    placed = ordered.select("node", "component", "size", alone.alias("alone"), F.posexplode("ordered").alias("at", "e"))
    placed = placed.select("node", "component", "size", F.col("e.element").alias("element"), (F.col("alone") + F.col("at")).alias("at"))
    # The smallest set that can be a partner asks for the fewest common elements.
    placed = placed.filter(F.col("at") + F.ceil(SIMILARITY * F.col("size") - 1e-6) <= F.col("size"))
    step = log(SIZE_RATIO)
    band = F.floor(F.log(F.col("size").cast("double")) / step).cast("int")
    reach = int(-log(SIMILARITY) / step) + 2
    placed = placed.withColumn("band", band)
    placed = placed.withColumn("partner", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach)))
    # A little below the smallest size of the partner's band.
    smallest = F.greatest(F.exp(F.col("partner") * step) - 1e-6, SIMILARITY * F.col("size"))
    placed = placed.filter((F.col("at") + _needed(F.col("size"), smallest) <= F.col("size")) & (
        SIMILARITY * smallest <= F.col("size") + 1e-6
    ))
    placed = placed.select(
        "element", F.least("band", "partner").alias("low"), F.greatest("band", "partner").alias("high"),
        "node", "component", "size", "at", "band",
    )
    placed = write_table(placed, "prefix-elements")
    key = ["element", "low", "high"]
    # Most members of a key may be of one component: they meet the others only.
    majors = placed.groupBy(*key, "component").agg(F.count("*").alias("n")).groupBy(*key).agg(
        F.max_by("component", "n").alias("major"), F.count("*").alias("components")
    )
    majors = write_table(majors.filter("components > 1").drop("components"), "prefix-keys")
    keyed = write_table(placed.join(majors.hint("merge"), key), "prefix-members")
    its = {name: f"its_{name}" for name in ("node", "component", "size", "at", "band")}
    minors = keyed.filter("component <> major").drop("major")
    partners = keyed.select(*key, "major", *[F.col(name).alias(new) for name, new in its.items()])
    needed = _needed(F.col("size"), F.col("its_size"))
    met = minors.join(partners.hint("merge"), key).filter(
        F.expr("component <> its_component AND (its_component = major OR node < its_node)")
        & F.expr("low = high OR band <> its_band")
        & (F.col("at") + needed <= F.col("size"))
        & (F.col("its_at") + needed <= F.col("its_size"))
    )
    return met.select(F.greatest("node", "its_node").alias("node"), F.least("node", "its_node").alias("leader")).distinct()


def _links(pairs: DataFrame, docs: DataFrame, sets: DataFrame, weighted: bool, turn: int) -> DataFrame:
    """The pairs whose similarity, on full sets, reaches the threshold."""
    led = pairs.select("node", F.lit(False).alias("leads"), F.lit(True).alias("follows"))
    leading = pairs.select(
        F.col("leader").alias("node"), F.lit(True).alias("leads"), F.lit(False).alias("follows")
    )
    nodes = led.unionByName(leading).groupBy("node").agg(
        F.max("leads").alias("leads"), F.max("follows").alias("follows")
    )
    full = _full_sets(nodes, docs, sets, weighted, turn)
    left = full.filter("follows").select("node", F.col("elements").alias("a"))
    right = full.filter("leads").select(F.col("node").alias("leader"), F.col("elements").alias("b"))
    shared = F.size(F.array_intersect("a", "b")).alias("shared")
    total = (F.size("a") + F.size("b")).alias("total")
    measured = pairs.join(left, "node").join(right, "leader").select("node", "leader", shared, total)
    # shared / (total - shared) reaches the threshold
    is_link = F.col("shared") * (1 + SIMILARITY) >= SIMILARITY * F.col("total") - 1e-9
    return measured.filter(is_link).select("node", "leader").distinct()


def components(links: DataFrame) -> DataFrame:
    """`(node, component)` for every node of the links `(node, leader)`: the smallest node reached.

    Smallest labels spread over links and along labels until none changes; every step is a written
    table, and nothing is collected.
    """
    edges = links.unionByName(links.select(F.col("leader").alias("node"), F.col("node").alias("leader")))
    edges = write_table(edges.distinct(), "edges")
    labels = edges.groupBy("node").agg(F.min("leader").alias("component"))
    labels = labels.select("node", F.least("node", "component").alias("component"))
    labels = write_table(labels, "labels")
    while True:
        of_leader = labels.select(F.col("node").alias("leader"), F.col("component").alias("offered"))
        offered = edges.join(of_leader, "leader").groupBy("node").agg(F.min("offered").alias("offered"))
        nearer = labels.join(offered, "node").select(
            "node", "component", F.least("component", "offered").alias("smaller")
        )
        jumps = nearer.select(F.col("node").alias("smaller"), F.col("smaller").alias("further"))
        jumped = nearer.join(jumps, "smaller").select(
            "node", F.least("smaller", "further").alias("component"), F.col("component").alias("before")
        )
        jumped = write_table(jumped, "labels-jumped")
        labels = jumped.select("node", "component")
        if jumped.filter("component <> before").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """`(doc_id, class_id)` of each document."""
    signed = write_table(signatures(docs, weighted), "signatures")
    firsts = [F.first(name).alias(name) for name in ("bands", "sketch", "mass")]
    sets = signed.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *firsts)
    sets = write_table(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    labels = sets.select("node", F.col("node").alias("component"))
    members = sets.select("node", F.explode("bands").alias("bucket"), F.col("node").alias("component"))
    members = _between_components(members)
    # Only these can be in a pair.
    shared = sets.drop("bands").join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    shared = write_table(shared, "shared-sets")
    turn, complete = 0, False
    while not complete and not members.isEmpty():
        pairs = write_table(_bucket_pairs(members, shared, turn), "pairs")
        links = write_table(_links(pairs, docs, shared, weighted, turn), "links")
        if links.isEmpty():
            # Leaders find no more: every pair that is left in a bucket is looked at.
            turn, complete = turn + 1, True
            pairs = write_table(_complete_pairs(members, docs, shared, weighted, turn), "pairs")
            links = write_table(_links(pairs, docs, shared, weighted, turn), "links")
            if links.isEmpty():
                break
        of = labels.select(F.col("node").alias("leader"), F.col("component").alias("other"))
        between = links.join(labels, "node").join(of, "leader")
        between = between.select(F.col("component").alias("node"), F.col("other").alias("leader"))
        merged = components(between).select(
            F.col("node").alias("component"), F.col("component").alias("merged")
        )
        labels = labels.join(merged, "component", "left").select(
            "node", F.coalesce("merged", "component").alias("component")
        )
        labels = write_table(labels, "components")
        if not complete:
            members = _between_components(members.select("bucket", "node").join(labels, "node"))
        turn += 1
    found = sets.join(labels, "node").select("set_key", "rep", "component")
    found = write_table(found, "set-components")
    smallest = found.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = found.join(smallest, "component").select("set_key", "class_id")
    return signed.select("doc_id", "set_key").join(write_table(classes, "classes"), "set_key").drop("set_key")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
