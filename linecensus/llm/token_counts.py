"""Greedy longest-match piece counts in one linear pass, without building pieces.

The vocabulary is a trie over characters with two roots: one for pieces that begin a word and one
for pieces that continue it. Every node has a failure link to the node of what remains after the
longest pieces before it are taken, and the number of pieces taken on the way (the popped tokens).
A word is walked character by character; where the trie ends, the link is followed and its number
added, so each character is met a bounded number of times on average and no piece is ever built.

A word is a maximal run of characters without white space or punctuation, or one punctuation
character (anything that is neither alphanumeric, an underscore nor white space). A word that the
vocabulary cannot spell counts as one unknown piece, as in word-piece tokenizers.

- A null or empty text has 0 words and 0 pieces.
- Texts and words of any length are counted whole.
- Repeated rows and a null `doc_id` are passed through; only `doc_id` and `text` are read.
- An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

WORDS = re.compile(r"\w+|[^\w\s]")
# Distinct words whose counts a Python worker remembers.
REMEMBERED = 300_000
# Characters of a text that are split into words at a time.
BLOCK = 1 << 20
_WORD_START = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that continue one, of a sentencepiece model.

    Control, unknown and byte pieces are left out.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    first, later = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        if not piece.startswith(_WORD_START):
            later.append(piece)
        elif len(piece) > 1 and _WORD_START not in piece[1:]:
            first.append(piece[1:])
    return first, later


class LongestMatch:
    """Trie with failure links and popped-piece counts."""

    FIRST, LATER = 0, 1

    def __init__(self, first: list[str], later: list[str]):
        self.goto: list[dict[str, int]] = [{}, {}]
        whole = {self._insert(self.FIRST, piece) for piece in first}
        whole |= {self._insert(self.LATER, piece) for piece in later}
        # Link of each node (-1: none) and pieces popped by following it.
        self.link = [-1] * len(self.goto)
        self.popped = [0] * len(self.goto)
        queue = deque([self.FIRST, self.LATER])
        while queue:
            node = queue.popleft()
            for char, child in self.goto[node].items():
                queue.append(child)
                if child in whole:
                    self.link[child], self.popped[child] = self.LATER, 1
                    continue
                back, taken = self.link[node], self.popped[node]
                while back >= 0 and char not in self.goto[back]:
                    taken += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[child], self.popped[child] = self.goto[back][char], taken

    def _insert(self, node: int, piece: str) -> int:
        for char in piece:
            if char not in self.goto[node]:
                self.goto[node][char] = len(self.goto)
                self.goto.append({})
            node = self.goto[node][char]
        return node

    def count(self, word: str) -> int:
        """Pieces of a word; 1 for a word that cannot be spelled, 0 for an empty one."""
        goto, link, popped = self.goto, self.link, self.popped
        node, pieces = self.FIRST, 0
        for char in word:
            while (following := goto[node].get(char)) is None:
                pieces += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = following
        while node > self.LATER:
            pieces += popped[node]
            node = link[node]
        return 1 if node < 0 else pieces


class Remembered(dict):
    """Counts of the words met so far, forgotten all at once when there are too many."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        pieces = self[word] = self.automaton.count(word)
        return pieces


def blocks(text: str) -> Iterator[str]:
    """The text in blocks that end before white space (a block without any grows until one)."""
    start = 0
    while start < len(text):
        end = start + BLOCK
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end


_LOADED: dict[str, Remembered] = {}


def _counts(path: str) -> Remembered:
    """The automaton of this worker, built from the vocabulary file once."""
    if path not in _LOADED:
        _LOADED[path] = Remembered(LongestMatch(*read_vocabulary(path)))
    return _LOADED[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`(doc_id, n_words, n_tokens)` of each document.

    `vocabulary` is a path that exists on every machine.
    """
    path = vocabulary or default_vocabulary()

    def count(batches):
        import pyarrow as pa

        known = _counts(path)
        for batch in batches:
            words, pieces = [], []
            for text in batch.column("text"):
                counted = Counter()
                for block in blocks(text.as_py() or ""):
                    counted.update(WORDS.findall(block))
                words.append(counted.total())
                pieces.append(sum(known[word] * times for word, times in counted.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(count, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and piece counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
