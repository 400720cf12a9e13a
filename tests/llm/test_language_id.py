import random

import numpy as np

from linecensus.llm import language_id as L
from tests.llm import frames

STEMS = {"aa": "ka lo mi ter un", "bb": "sch ung eit ver tz", "cc": "eau oui éne ço tre"}


def labelled(count, start=0):
    rows = []
    for i in range(count):
        lang = sorted(STEMS)[i % 3]
        rows.append((start + i, frames.invented(60, start + i, STEMS[lang]), lang))
    return rows


def test_held_out_accuracy(spark):
    docs = frames.docs(spark, labelled(300))
    found = L.identify(docs, L.train(L.labelled_sample(docs)), ["doc_id", "lang"])
    rows = found.collect()
    assert len(rows) == 300
    assert sum(r.lang == r.lang_pred for r in rows) >= 298
    assert all(0 <= r.score <= 1 for r in rows)


def phrases(text, reference):
    """Greedy cross-parsing by substring search, in segments."""
    count = 0
    for start in range(0, len(text), L.SEGMENT):
        segment = text[start : start + L.SEGMENT]
        at = 0
        while at < len(segment):
            size = 1
            while at + size <= len(segment) and segment[at : at + size] in reference:
                size += 1
            at += max(size - 1, 1)
            count += 1
    return count


def test_phrases_are_those_of_substring_search():
    chance = random.Random(3)
    sample = [(lang, frames.invented(80, k, stems)) for k, (lang, stems) in enumerate(STEMS.items())]
    model = L.train(sample)
    references = [f"{L.lower_letters(text)} " for _, text in sample]
    of = {" ": 0} | {c: i + 2 for i, c in enumerate(model.letters)}
    for k in range(60):
        text = L.lower_letters(frames.invented(chance.randint(1, 90), k, "ka ver eau lo ung q"))
        classes = np.full((-(-len(text) // L.SEGMENT), L.SEGMENT), model.width - 1, np.uint8)
        for i, char in enumerate(text):
            classes[i // L.SEGMENT, i % L.SEGMENT] = of.get(char, 1)
        got = model.parse(classes).sum(axis=0)
        assert got.tolist() == [phrases(text, reference) for reference in references], text


def test_awkward_rows(spark):
    docs = frames.docs(spark)
    rows = L.identify(docs, L.train(L.labelled_sample(docs)), docs.columns).collect()
    assert len(rows) == len(frames.ROWS)
    for row, (doc_id, text, _) in zip(rows, frames.ROWS):
        assert row.doc_id == doc_id and row.text == text
        undetermined = not any(c.isalpha() for c in text or "")
        assert (row.lang_pred == L.UNDETERMINED) == undetermined
        assert not undetermined or row.score == 0


def test_without_labels_or_rows(spark):
    model = L.train([])
    docs = frames.docs(spark)
    assert {r.lang_pred for r in L.identify(docs, model, ["doc_id"]).collect()} == {L.UNDETERMINED}
    nothing = frames.empty(spark)
    assert L.identify(nothing, L.train(L.labelled_sample(nothing)), ["doc_id"]).collect() == []


# First letter and number of letters of some scripts.
SCRIPTS = {"ha": (0x4E00, 900), "ho": (0xAC00, 700), "de": (0x905, 48), "ja": (0x4E00, 300)}


def script_text(lang, words, seed):
    first, count = SCRIPTS[lang]
    chance = random.Random(seed)
    # Words from a small vocabulary, so that phrases of the sample come again.
    vocabulary = random.Random(lang)
    stems = ["".join(chr(first + vocabulary.randrange(count)) for _ in range(3)) for _ in range(300)]
    return " ".join(chance.choice(stems) for _ in range(words))


def test_scripts_of_many_letters(spark):
    rows = [(i, script_text(sorted(SCRIPTS)[i % 4], 60, i), sorted(SCRIPTS)[i % 4]) for i in range(200)]
    docs = frames.docs(spark, rows)
    model = L.train(L.labelled_sample(docs))
    assert len(model.letters) > 3 * L.DENSE
    found = L.identify(docs, model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 198


def test_letters_outside_the_table_change_nothing(monkeypatch):
    sample = [(lang, script_text(lang, 150, 1)) for lang in sorted(SCRIPTS)] + [("xx", frames.invented(80, 3))]
    references = [f"{L.lower_letters(text)} " for _, text in sample]
    texts = [L.lower_letters(script_text(lang, 70, 2) + " ka lo ω 中 ") for lang in sorted(SCRIPTS)]
    wanted = [[phrases(text, reference) for reference in references] for text in texts]
    for dense in (0, 3, 120, 5000):
        monkeypatch.setattr(L, "DENSE", dense)
        model = L.train(sample)
        of = {" ": 0} | L._classes(model.letters)
        for text, want in zip(texts, wanted):
            classes = np.full((-(-len(text) // L.SEGMENT), L.SEGMENT), model.padding, np.int32)
            for i, char in enumerate(text):
                classes[i // L.SEGMENT, i % L.SEGMENT] = of.get(char, 1)
            assert model.parse(classes).sum(axis=0).tolist() == want


def test_sample_is_by_row_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS", 5)
    monkeypatch.setattr(L, "LONGEST", 400)
    monkeypatch.setattr(L, "REFERENCE", 500)
    same = [(1, frames.invented(30, i), "aa") for i in range(40)]
    long = [(2, frames.invented(5000, 50), "bb"), (3, frames.invented(6000, 51), "bb")]
    sample = L.labelled_sample(frames.docs(spark, same + long))
    assert [lang for lang, _ in sample] == ["aa"] * 5 + ["bb"] * 2
    assert {text for lang, text in sample if lang == "aa"} <= {text for _, text, _ in same}
    assert len({text for lang, text in sample if lang == "aa"}) == 5
    assert {text for lang, text in sample if lang == "bb"} == {text[:500] for _, text, _ in long}
