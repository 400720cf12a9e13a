import random
import re

import numpy as np

from linecensus.llm import near_dedup as N
from tests.llm import frames


def word_shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    """Smallest doc_id of the component of each row, over all pairs."""
    sets = [word_shingles(text) for _, text, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 1.8 * shared >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-9:
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, *_) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[i][0], smallest[find(i)]) for i in range(len(rows))), key=repr)


def classes(frame):
    return sorted(((r.doc_id, r.class_id) for r in frame.collect()), key=repr)


def edited(text, share, chance):
    return " ".join(f"new{chance.randint(0, 10**6)}" if chance.random() < share else w for w in text.split())


def test_awkward_rows(spark):
    assert classes(N.near_duplicates(frames.docs(spark))) == brute_force(frames.ROWS)


def test_empty_table(spark):
    assert N.near_duplicates(frames.empty(spark)).collect() == []


def test_classes_against_all_pairs(spark):
    chance = random.Random(6)
    hot = frames.invented(120, 1)
    rows = []
    for i in range(400):
        kind = i % 4
        if kind == 0:  # a large group of near copies of very different closeness
            text = edited(hot, chance.choice([0.003, 0.01, 0.02, 0.04, 0.08]), chance)
        elif kind == 1 and rows:
            text = edited(chance.choice(rows)[1], chance.choice([0, 0.01, 0.03]), chance)
        else:
            text = frames.invented(chance.randint(5, 150), 1000 + i)
        rows.append((i, text, "en"))
    assert classes(N.near_duplicates(frames.docs(spark, rows, clashing=False))) == brute_force(rows)


def test_pairs_hidden_among_templates(spark):
    """2,000 documents at 0.69 to each other; 50 pairs of them are at 0.86."""
    template = frames.invented(140, 3)
    rows = []
    for i in range(2000):
        tail = [f"own{i}x{n}" for n in range(30)]
        if i < 100:
            tail[:18] = [f"pair{i // 2}x{n}" for n in range(18)]
        rows.append((i, f"{template} {' '.join(tail)}", "en"))
    found = classes(N.near_duplicates(frames.docs(spark, rows, clashing=False)))
    assert found == sorted(((i, i - i % 2 if i < 100 else i) for i in range(2000)), key=repr)


def test_prefix_pairs_against_all_pairs(spark):
    """Every pair at the threshold is returned, whatever the sizes and the components."""
    chance = random.Random(11)
    sets = [set(chance.sample(range(60), chance.randint(1, 50))) for _ in range(60)]
    for i in range(120):
        base = set(chance.choice(sets))
        base ^= set(chance.sample(range(60), chance.randint(0, 6)))
        sets.append(base or {1})
    rows = [(i, i % 150, sorted(s)) for i, s in enumerate(sets)]
    full = spark.createDataFrame(rows, "node bigint, component bigint, elements array<bigint>")
    found = {(r.node, r.leader) for r in N._prefix_pairs(full).collect()}
    wanted = {
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if i % 150 != j % 150 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    }
    assert len(wanted) > 50 and wanted <= found


def test_weighted_sets_count_repetitions(spark):
    line = "one two three four five six seven"
    rows = [(1, " ".join([line] * 2), "en"), (2, " ".join([line] * 40), "en")]
    docs = frames.docs(spark, rows)
    assert classes(N.near_duplicates(docs)) == [(1, 1), (2, 1)]
    assert classes(N.near_duplicates(docs, weighted=True)) == [(1, 1), (2, 2)]


def test_agreement_is_the_weighted_similarity():
    chance = np.random.default_rng(0)
    a = chance.exponential(5, 40)
    b = a * chance.uniform(0.5, 1.5, 40)
    agreed = []
    for trial in range(30):
        elements = N.mixed(np.arange(1, 41, dtype=np.uint64) + np.uint64(1000 * trial))
        both = N.dart_signatures(np.r_[elements, elements], np.r_[a, b], np.repeat([0, 1], 40), 2, 256)
        agreed.append((both[0] == both[1]).mean())
    assert abs(np.mean(agreed) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_signatures_do_not_depend_on_neighbours():
    sets = [N.mixed(np.arange(n, dtype=np.uint64) + np.uint64(7 * n)) for n in (1, 3, 50, 2000)]
    together = N.dart_signatures(
        np.concatenate(sets), np.ones(sum(map(len, sets))), np.repeat(range(4), [len(s) for s in sets]), 4
    )
    for i, elements in enumerate(sets):
        alone = N.dart_signatures(elements, np.ones(len(elements)), np.zeros(len(elements), int), 1)
        assert (alone[0] == together[i]).all()
        assert (alone != np.iinfo(np.uint64).max).all()


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    found = N.components(spark.createDataFrame(links, "node bigint, leader bigint"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)}
