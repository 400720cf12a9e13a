"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text knows every substring of that text. A
document is cut greedily into the longest phrases that occur in it; the fewer phrases a language
needs per character, normalised by the size of its text, the closer the document is to it.

The automata become one table of transitions over letter classes, so that a batch of documents is
parsed in lockstep: text is cut into segments of `SEGMENT` classes (each begins a new phrase, in
every language alike), and one numpy step advances all segments in all languages by a character. Transitions by
letters beyond the `DENSE` commonest are kept in a sorted list instead, which changes no result.

Text is reduced to lower-case letters and single spaces for everything between them. The labelled
text is a bounded sample: of every language the `ROWS` documents with the smallest hash of their
identifier among those of `SHORTEST` to `LONGEST` characters (of any length where a language has none
of these, and then at most `REFERENCE` of its characters), until `REFERENCE` characters are reached.

- A null text and one without a letter give `und` with score 0.
- Text of letters that no language has is assigned to the first language by name with a low score.
- Ties go to the language that sorts first.
- Without any labelled row, every document is `und`.
- Rows without `doc_id` are not learned from; rows of one `doc_id` are different documents.
- A null `doc_id` and repeated rows are passed through; extra columns are ignored.
- An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecensus.llm.common import held_out, located, place_columns

UNDETERMINED = "und"
ROWS = 60
SHORTEST, LONGEST = 100, 4000
REFERENCE = 30_000
SEGMENT = 256
# Characters of a batch that are parsed at a time.
BLOCK = 2_000_000
# Letter classes: 0 is a space, 1 any letter that the sample lacks, then the letters of the sample: the `DENSE`
# commonest, after a class for padding the others.
_SPACE, _OTHER = 0, 1
DENSE = 120


def labelled_sample(docs: DataFrame, language: str = "lang") -> list[tuple[str, str]]:
    """`(language, text)` of the sample, at most `ROWS` per language, in a fixed order.

    The ranking runs on identifiers and places; texts, cut to a bounded length, are fetched for the chosen rows only.
    """
    labelled = located(docs.select(F.col(language).alias("lang"), "doc_id", "text"))
    labelled = labelled.select("lang", "doc_id", "text", *place_columns(), F.char_length("text").alias("chars"))
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    labelled = labelled.filter(~held_out(F.col("doc_id")))
    unusual = F.when(F.col("chars").between(SHORTEST, LONGEST), 0).otherwise(1)
    order = Window.partitionBy("lang").orderBy("unusual", "hash", "doc_id", "file", "row")
    ranked = labelled.select(
        "lang", "doc_id", "file", "row", unusual.alias("unusual"), F.xxhash64("doc_id").alias("hash")
    )
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ROWS)
    chosen = ranked.select("file", "row", "rank")  # languages * ROWS rows
    texts = labelled.join(F.broadcast(chosen), ["file", "row"])
    found = texts.select("lang", "rank", F.left("text", F.lit(max(LONGEST, REFERENCE))).alias("text")).collect()
    return [(row.lang, row.text) for row in sorted(found, key=lambda row: (row.lang, row.rank))]


class Model:
    """Languages, letter classes and the transitions of all automata."""

    def __init__(self, languages: list[str], letters: str, automata: list[Automaton], sizes: list[int]):
        self.languages = languages
        self.letters = letters
        self.padding = min(len(letters), DENSE) + 2
        self.width = self.padding + 1
        tables = [table for table, _ in automata]
        self.starts = np.cumsum([0] + [len(t) for t in tables[:-1]]).astype(np.int32)
        shifted = [np.where(t < 0, t - s, t + s) for t, s in zip(tables, self.starts)]
        self.table = np.concatenate(shifted).astype(np.int32).ravel() if tables else None
        self.unknown = np.array([s + len(t) - 1 for t, s in zip(tables, self.starts)], np.int32)
        # Transitions by the other letters, in the order of `state * span + class`.
        self.span = len(letters) + 3
        edges = [(s + at, letter, s + to) for (_, rare), s in zip(automata, self.starts) for at, letter, to in rare]
        at, letter, to = np.array(edges, np.int64).reshape(-1, 3).T
        keys = at * self.span + letter
        order = np.argsort(keys)
        self.rare_keys, self.rare_states = keys[order], to[order].astype(np.int32)
        # Bits that a phrase costs: a position in the language's own text.
        self.bits = np.array([math.log2(max(2, size)) for size in sizes])

    def _rare(self, state: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state by rare letters, and whether there is a transition."""
        keys = state.astype(np.int64) * self.span + letters
        places = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        return self.rare_states[places], self.rare_keys[places] == keys

    def _rare_step(self, state: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Like an entry of the table: the next state, or the complement of that after a restart."""
        begin = np.broadcast_to(self.starts[:, None], state.shape)
        following, known = self._rare(state, letters)
        first, has = self._rare(begin, letters)
        first = np.where(has, first, self.unknown[:, None])
        return np.where(known, following, np.where(state == begin, first, ~first))

    def parse(self, classes: np.ndarray) -> np.ndarray:
        """Phrases of each segment (row of letter classes) in each language."""
        lanes = classes.shape[0]
        state = np.repeat(self.starts[:, None], lanes, axis=1)
        phrases = np.zeros(state.shape, np.int32)
        for column in np.ascontiguousarray(classes.T, dtype=np.int32):
            rare = np.flatnonzero(column > self.padding) if len(self.rare_keys) else ()
            if len(rare):
                by_rare = self._rare_step(state[:, rare], column[rare])
                column = np.where(column > self.padding, _OTHER, column)
            # A negative entry: no transition; the phrase ends and a new one begins with the letter.
            state = self.table[state * self.width + column]
            if len(rare):
                state[:, rare] = by_rare
            ended = state < 0
            phrases += ended
            np.invert(state, out=state, where=ended)
        return phrases.T + 1


# Table of transitions, and those by classes beyond its width as `(state, class, next state)`.
Automaton = tuple[np.ndarray, list[tuple[int, int, int]]]


def suffix_automaton(text: list[int], width: int) -> Automaton:
    """Transitions (states x classes below `width`, and a list of the others) of all substrings of `text`.

    An entry is the next state, or the complement of the state after restarting with the letter. A
    letter that the text lacks is a phrase of its own, which has the last state. The last class of the table
    is padding and leaves every state as it is.
    """
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for letter in text:
        current = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and letter not in following[at]:
            following[at][letter] = current
            at = link[at]
        if at >= 0:
            target = following[at][letter]
            if length[at] + 1 == length[target]:
                link[current] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and following[at].get(letter) == target:
                    following[at][letter] = copy
                    at = link[at]
                link[target] = link[current] = copy
        last = current
    unknown = len(following)
    restart = np.full(width, ~unknown, np.int64)
    for letter, state in following[0].items():
        if letter < width:
            restart[letter] = ~state
    table = np.tile(restart, (unknown + 1, 1))
    table[0] = unknown
    rare = []
    for state, edges in enumerate(following):
        for letter, to in edges.items():
            if letter < width:
                table[state, letter] = to
            else:
                rare.append((state, letter, to))
    table[:, -1] = np.arange(unknown + 1)
    return table, rare


def lower_letters(text: str) -> str:
    """Lower-case letters, and one space for anything between them."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def train(sample: list[tuple[str, str]]) -> Model:
    texts: dict[str, str] = {}
    for language, text in sample:
        if len(texts.setdefault(language, "")) < REFERENCE:
            texts[language] = f"{texts[language]}{lower_letters(text)} "
    texts = {language: text for language, text in sorted(texts.items()) if text.strip()}
    usual = Counter("".join(texts.values()))
    del usual[" "]
    ranked = [c for c, _ in usual.most_common()]
    letters = "".join(sorted(ranked[:DENSE]) + sorted(ranked[DENSE:]))
    of = {" ": _SPACE} | _classes(letters)
    width = min(len(letters), DENSE) + 3
    automata = [suffix_automaton([of[c] for c in text], width) for text in texts.values()]
    return Model(list(texts), letters, automata, [len(text) for text in texts.values()])


def _classes(letters: str) -> dict[str, int]:
    """Class of each letter; that of padding is left out."""
    return {c: i + 2 + (i >= DENSE) for i, c in enumerate(letters)}


def class_table(letters: str) -> np.ndarray:
    """Letter class of every code point; upper case has that of its lower case."""
    table = np.zeros(0x110000, np.int32 if len(letters) > DENSE else np.uint8)
    of = _classes(letters)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = of.get(char.lower()[0], _OTHER)
    return table


_TABLES: dict[str, np.ndarray] = {}


def _class_table(letters: str) -> np.ndarray:
    if letters not in _TABLES:
        _TABLES.clear()
        _TABLES[letters] = class_table(letters)
    return _TABLES[letters]


def _slices(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """The texts in blocks of about `BLOCK` characters, as `(index, piece of text)`."""
    block, size = [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text or ""), BLOCK):
            piece = text[start : start + BLOCK]
            block.append((i, piece))
            size += len(piece)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def classify(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    count = len(model.languages)
    phrases = np.zeros((len(texts), max(1, count)))
    chars = np.zeros(len(texts), np.int64)
    letters = np.zeros(len(texts), np.int64)
    table = _class_table(model.letters)
    padding = model.padding
    for block in _slices(texts) if count else ():
        owner = np.repeat([i for i, _ in block], [len(piece) for _, piece in block])
        codes = np.frombuffer("".join(p for _, p in block).encode("utf-32-le", "replace"), np.uint32)
        classes = table[codes]
        # One space between words, none at the beginning of a piece.
        fresh = np.ones(len(owner), bool)
        fresh[1:] = owner[1:] != owner[:-1]
        blank = classes == _SPACE
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1] & ~fresh[1:]
        classes, owner = classes[keep], owner[keep]
        if not len(owner):
            continue
        chars += np.bincount(owner, minlength=len(texts))
        letters += np.bincount(owner[classes != _SPACE], minlength=len(texts))
        # Segments: every `SEGMENT` classes of a text.
        begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lengths = np.diff(np.r_[begins, len(owner)])
        within = np.arange(len(owner)) - np.repeat(begins, lengths)
        segments = -(-lengths // SEGMENT)
        first = np.cumsum(segments) - segments
        rows = np.repeat(first, lengths) + within // SEGMENT
        lanes = np.full((segments.sum(), SEGMENT), padding, table.dtype)
        lanes[rows, within % SEGMENT] = classes
        np.add.at(phrases, np.repeat(owner[begins], segments), model.parse(lanes))
    known = (letters > 0) & (count > 0)
    rates = phrases * (model.bits if count else 1) / np.maximum(chars, 1)[:, None]
    best = rates.argmin(axis=1)
    # How far the winner is below the mean of all languages; 1 for a single language.
    spread = np.exp(-(rates - rates.min(axis=1, keepdims=True)) * np.log(2) * 8)
    scores = np.where(known, 1 / spread.sum(axis=1), 0.0)
    languages = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
    return languages, scores.tolist()


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` with `lang_pred` and `score`.

    The model is bounded by the parameters above and the number of languages; it goes to each
    executor once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in keep if c not in ("lang_pred", "score")]

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            languages, scores = classify(texts, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                [*columns, "lang_pred", "score"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns]
    schema = ", ".join([*fields, "lang_pred string", "score double"])
    needed = docs.select(*columns, *(() if "text" in columns else ("text",)))
    return needed.mapInArrow(predict, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(labelled_sample(docs)), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
