import random

import pytest
from tokenizers import models

from linecensus.llm import token_counts as T
from tests.llm import frames


@pytest.fixture(scope="module")
def vocabulary():
    return T.read_vocabulary(T.default_vocabulary())


def library(first, later):
    vocab = {}
    for piece in first:
        vocab.setdefault(piece, len(vocab))
    for piece in later:
        vocab.setdefault("##" + piece, len(vocab))
    vocab["[UNK]"] = len(vocab)
    return models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6)


def test_counts_are_those_of_a_word_piece_library(vocabulary):
    automaton, reference = T.LongestMatch(*vocabulary), library(*vocabulary)
    chance = random.Random(5)
    words = ["".join(chance.choice("abcdetinors éß日1") for _ in range(chance.randint(1, 15))) for _ in range(5000)]
    words += frames.invented(3000, 1).split()
    for word in (w for text in words for w in text.split()):
        assert automaton.count(word) == len(reference.tokenize(word)), word


def test_small_vocabulary_needs_failure_links():
    first, later = ["a", "abcdx"], ["b", "c", "cdy", "dz"]
    automaton, reference = T.LongestMatch(first, later), library(first, later)
    chance = random.Random(2)
    for _ in range(20000):
        word = "a" + "".join(chance.choice("abcdxyz") for _ in range(chance.randint(0, 8)))
        assert automaton.count(word) == len(reference.tokenize(word)), word


def test_awkward_rows(spark):
    rows = T.token_counts(frames.docs(spark)).collect()
    assert len(rows) == len(frames.ROWS)
    by_text = {}
    for row, (doc_id, text, _) in zip(rows, frames.ROWS):
        assert row.doc_id == doc_id
        assert row.n_words == len(T.WORDS.findall(text or ""))
        by_text.setdefault(text, set()).add((row.n_words, row.n_tokens))
    assert by_text[None] == by_text[""] == {(0, 0)}
    assert all(len(found) == 1 for found in by_text.values())


def test_empty_table(spark):
    assert T.token_counts(frames.empty(spark)).collect() == []


def test_blocks_cut_no_word():
    text = "ab " * 700_000 + "x" * 3_000_000 + " end"
    assert "".join(T.blocks(text)) == text
    assert sum(len(block.split()) for block in T.blocks(text)) == len(text.split())
