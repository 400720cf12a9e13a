import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linecensus.llm import jaccard_join as module
from linecensus.llm.jaccard_join import (
    common_elements, differing_elements, group_lists, jaccard_components, largest_partner, op11_ngram_jaccard_join,
    parity, shingle_set, subset_lists,
)
from tests.llm.frames import docs, empty, invented

COLUMNS = ["doc_id", "n_shingles", "component_id", "n_links"]
LOWER = {c: c + 32 for c in range(65, 91)}


def word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if 0 < len(words) < 3:
        return frozenset([tuple(words)])
    return frozenset(zip(words, words[1:], words[2:]))


def brute(rows):
    """`(doc_id, n_shingles, component_id)` of rows `(doc_id, text)` with distinct ids, by all pairs."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[word_shingles(text)].append(i)
    sets = [s for s in groups if s]
    holding = defaultdict(list)
    for number, s in enumerate(sets):
        for shingle in s:
            holding[shingle].append(number)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for number, s in enumerate(sets):
        common = Counter(other for shingle in s for other in holding[shingle] if other < number)
        for other, shared in common.items():
            if 100 * shared >= 90 * (len(s) + len(sets[other]) - shared):
                root[find(number)] = find(other)
    smallest = {}
    for number, s in enumerate(sets):
        top = find(number)
        smallest[top] = min(smallest.get(top, min(groups[s])), min(groups[s]))
    of = {s: smallest[find(number)] for number, s in enumerate(sets)}
    return sorted((i, len(s), of.get(s, i)) for s, ids in groups.items() for i in ids)


def found(result):
    assert result.columns == COLUMNS
    return sorted(tuple(r)[:3] for r in result.collect())


def joined(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    return found(jaccard_components(frame.selectExpr("*", "1 AS node", "'x' AS list", "2 AS size", "3 AS file")))


def without(words, chance, left_out):
    gone = set(chance.sample(range(len(words)), left_out))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_registered_query_against_all_pairs(spark):
    data = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op11_ngram_jaccard_join(spark, data)) == brute(rows)


def family(chance, count, length, most):
    words = [f"w{chance.randint(0, 10**6)}" for _ in range(length)]
    return [without(words, chance, chance.randint(0, min(most, length - 1))) for _ in range(count)]


@pytest.mark.parametrize("heavy_rows", [256, 8])
def test_families_of_every_size(spark, monkeypatch, heavy_rows):
    monkeypatch.setattr(module, "HEAVY_ROWS", heavy_rows)
    monkeypatch.setattr("linecensus.llm.common.HEAVY_ROWS", heavy_rows)
    monkeypatch.setattr("linecensus.llm.common.HEAVY_KEYS", 20)
    monkeypatch.setattr(module, "HEAVY_KEYS", 20)
    monkeypatch.setattr(module, "PART", 16)
    chance = random.Random(heavy_rows)
    texts = []
    for length in (1, 2, 3, 4, 8, 11, 12, 20, 21, 22, 30, 45, 66, 70, 120, 400, 2500):
        texts += family(chance, 25, length, max(1, length // 40))
    texts += family(chance, 150, 120, 6) + family(chance, 150, 120, 2)
    chance.shuffle(texts)
    rows = list(enumerate(texts))
    assert joined(spark, rows) == brute(rows)


def test_near_copies_round_one_text_and_a_shared_passage(spark):
    chance = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    passage = invented(60, 9)
    rows = [(i, without(base, chance, 2)) for i in range(300)]
    rows += [(1000 + i, f"{invented(100, i)} {passage} {invented(100, 1000 + i)}") for i in range(200)]
    rows += [(2000 + i, passage) for i in range(40)]
    assert joined(spark, rows) == brute(rows)


def test_links_are_counted(spark):
    a = [f"a{i}" for i in range(100)]
    texts = [" ".join(a), " ".join(a), " ".join(a[:-1]), "alone in the world", None]
    result = jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert [r["n_links"] for r in result.orderBy("doc_id").collect()] == [2, 2, 2, 0, 0]


def test_awkward_rows(spark):
    result = jaccard_components(docs(spark))
    assert result.columns == COLUMNS
    rows = {(r["doc_id"], r["n_shingles"]): r for r in result.collect()}
    fox = rows[(1, 12)]["component_id"]
    assert result.count() == 11
    assert [r["component_id"] for r in result.filter("n_shingles = 12").collect()] == [fox] * 4
    assert rows[(2, 0)]["component_id"] == 2 and rows[(None, 0)]["component_id"] is None
    assert rows[(1, 12)]["n_links"] == 3 and rows[(3, 0)]["n_links"] == 0
    assert jaccard_components(empty(spark)).count() == 0


def test_words_are_those_of_the_contract():
    assert len(shingle_set("A b\x1cc\xa0d e\x0bf")) == len(word_shingles("A b\x1cc\xa0d e\x0bf")) == 2
    assert np.array_equal(shingle_set("ÄB c D"), shingle_set("Äb C\td"))
    assert not np.array_equal(shingle_set("ÄB c D"), shingle_set("äb c d"))
    assert not np.array_equal(shingle_set("a b"), shingle_set("a b c"))
    long = "word " * 300_000 + "end"
    assert len(shingle_set(long)) == 2


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 700), st.integers(0, 80), st.integers(0, 80), st.integers(0, 2**32))
def test_linked_sets_share_a_list(common, only_a, only_b, seed):
    chance = np.random.default_rng(seed)
    values = np.unique(chance.integers(0, 2**64, common + only_a + only_b, dtype=np.uint64))
    chance.shuffle(values)
    a = np.sort(np.r_[values[:common], values[common : common + only_a]])
    b = np.sort(np.r_[values[:common], values[common + only_a :]])
    differing = len(a) + len(b) - 2 * common
    linked = 100 * common >= 90 * (common + differing)
    assert linked == (common >= common_elements(len(a), len(b)))
    assert linked == (differing <= differing_elements(len(a), len(b)))
    bits = sum(int(x).bit_count() for x in (parity(a) ^ parity(b)).view(np.uint64))
    assert bits <= differing
    if not linked:
        return
    assert max(len(a), len(b)) <= largest_partner(min(len(a), len(b)))
    assert set(group_lists(a).tolist()) & set(group_lists(b).tolist())
    if max(len(a), len(b)) <= 40:
        sizes = sorted({len(a), len(b)})
        assert set(subset_lists(a, sizes, 40).tolist()) & set(subset_lists(b, sizes, 40).tolist())


def test_boundary_follows_the_cost():
    few_large = module.best_boundary({5: 1000, 12: 1000, 64: 1})
    assert 12 <= few_large < 64
    assert module.best_boundary({60: 10, 63: 10}) < 60
    assert module.best_boundary({}) == 0


def links_by_pairs(rows):
    """`(doc_id, n_links)`: all other rows that are linked with each, by all pairs."""
    sets = [(i, word_shingles(text)) for i, text in rows]
    linked = dict.fromkeys((i for i, _ in rows), 0)
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 90 * max(len(a), len(b)) <= 100 * min(len(a), len(b)) and 100 * len(a & b) >= 90 * len(a | b):
                linked[i] += 1
                linked[j] += 1
    return sorted(linked.items())


@pytest.mark.parametrize("part,elements,multiplied", [(512, 1 << 20, 1 << 12), (7, 1 << 20, 16), (512, 300, 64)])
def test_every_link_of_a_family_is_counted(spark, monkeypatch, part, elements, multiplied):
    monkeypatch.setattr(module, "PART", part)
    monkeypatch.setattr(module, "PART_ELEMENTS", elements)
    monkeypatch.setattr(module, "MULTIPLIED", multiplied)
    chance = random.Random(17)
    texts = [t for length in (3, 12, 25, 60, 200) for t in family(chance, 20, length, max(1, length // 30))]
    texts += texts[:15] + family(chance, 120, 90, 4) + [None, "", "alone in the world"]
    # A chain: neighbours are linked, ends are not.
    chain = [f"c{i}" for i in range(260)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 200, 2)]
    chance.shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    result = jaccard_components(frame).select("doc_id", "n_links").collect()
    assert sorted(tuple(r) for r in result) == links_by_pairs(rows)


def test_common_elements_of_all_pairs():
    chance = np.random.default_rng(3)
    sets = [np.unique(chance.integers(0, 90, n, dtype=np.int64)) for n in (0, 1, 5, 40, 80, 80)]
    expected = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets]
    assert module.common_counts(sets, sets[2:]).tolist() == expected
