import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from linecensus.llm import packing as P
from tests.llm import frames


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.default_tokenizer())


def expected_pieces(tokenizer, text, capacity):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END_ID]
    return [ids[i : i + capacity] for i in range(0, len(ids), capacity)]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_ids_are_those_of_the_library(tokenizer):
    encoder, chance = P.Encoder(P.default_tokenizer()), random.Random(3)
    assert encoder.splits
    letters = "abAB éÉßüÄ'´.,!?|<>*#_-1² \n\t　\xa0İΣςʼ’é日本\x1c\x0b`~{}[]\\^@"
    plain = "abAB éÉß.,!?|*#_-1 \n"
    for k in range(6000):
        text = "".join(chance.choice(plain if k % 2 else letters) for _ in range(chance.randint(0, 14)))
        assert b"".join(encoder.encode(text)) == packed(tokenizer.encode(text, add_special_tokens=False).ids)
    special = "a <|endoftext|> b <|startoftext|>"
    assert b"".join(encoder.encode(special)) == packed(
        tokenizer.encode(special, add_special_tokens=False).ids
    )


def test_other_tokenizers_encode_whole_texts():
    path = P.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    encoder, library = P.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.splits
    text = "Two  spaces, and a line\nbreak."
    assert b"".join(encoder.encode(text)) == packed(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("capacity", [7, 4096])
def test_every_piece_has_a_place(spark, tokenizer, capacity):
    rows = P.pack_documents(frames.docs(spark), capacity=capacity, with_ids=True).collect()
    wanted = sorted(
        (packed(ids), k, k * capacity)
        for _, text, _ in frames.ROWS
        for k, ids in enumerate(expected_pieces(tokenizer, text, capacity))
    )
    assert sorted((bytes(r.ids), r.piece, r.start) for r in rows) == wanted
    sequences = {}
    for row in rows:
        assert row.length == len(row.ids) // 4 and row.ids_crc32 == zlib.crc32(row.ids)
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


def test_empty_table(spark):
    assert P.pack_documents(frames.empty(spark)).collect() == []


def used(patterns):
    counts = {}
    for lengths, times in patterns:
        for length in lengths:
            counts[length] = counts.get(length, 0) + times
    return counts


def test_plans_use_every_length_and_never_exceed():
    chance = random.Random(9)
    for k in range(200):
        capacity = chance.choice([5, 16, 100])
        counts = {chance.randint(1, capacity): chance.randint(1, 50) for _ in range(chance.randint(1, 30))}
        patterns = P.pack_lengths(counts, capacity)
        assert used(patterns) == counts
        assert all(sum(lengths) <= capacity and times > 0 for lengths, times in patterns)
        total = sum(length * count for length, count in counts.items())
        halves = counts.get(capacity // 2, 0) if capacity % 2 == 0 else 0
        alone = sum(c for x, c in counts.items() if 2 * x > capacity) + -(-halves // 2)
        needed = max(-(-total // capacity), alone)
        assert sum(times for _, times in patterns) <= 1.25 * needed + 1, (capacity, counts)


def test_exact_complements_of_one_two_and_three():
    assert P.pack_lengths({60: 3, 40: 3}, 100) == [([60, 40], 3)]
    assert sorted(P.pack_lengths({50: 2, 30: 2, 20: 2}, 100)[0][0]) in ([50, 50], [20, 30, 50])
    (lengths, times), *rest = P.pack_lengths({70: 4, 10: 12}, 100)
    assert sorted(lengths) == [10, 10, 10, 70] and times == 4 and not rest


def test_a_length_of_a_third_of_all_rows(spark):
    rows = [(i, "the same text" if i % 3 else frames.invented(1 + i % 40, i), "en") for i in range(900)]
    pieces = P.pack_documents(frames.docs(spark, rows, clashing=False), capacity=64).collect()
    places = {(r.sequence_id, r.offset) for r in pieces}
    assert len(places) == len(pieces)
    total = sum(r.length for r in pieces)
    assert len({r.sequence_id for r in pieces}) <= -(-total // 64) + 2
