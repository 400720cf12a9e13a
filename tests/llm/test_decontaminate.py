import random
import re

import regex

from linecensus.llm import decontaminate as D
from tests.llm import frames

QUESTION = (
    "Yesterday the farmer Alice sold 48 apples and 12 pears to her friend Bob for 3 dollars each in the "
    "market of Paris and kept 48 eggs for later."
)


def asked(name, apples, pears, friend, price, town, eggs):
    return (
        f"Yesterday the farmer {name} sold {apples} apples and {pears} pears to her friend {friend} for "
        f"{price} euros each in the market of {town} and kept {eggs} eggs for later."
    )


def benchmark(spark, texts):
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "item_id bigint, text string")
    return frame.selectExpr("*", *[f"'{n}' AS `{n}`" for n in ("hash", "at", "place", "shift", "words", "doc_id")])


def found(spark, texts, items):
    docs = frames.docs(spark, [(i, text, "en") for i, text in enumerate(texts)])
    return {(r.doc_id, r.item_id): r for r in D.contaminated(docs, benchmark(spark, items)).collect()}


def test_same_and_changed_questions(spark):
    filler = frames.invented(60, 1)
    texts = [
        f"{filler} {QUESTION} {filler}",
        f"{filler}\n{asked('Maria', 5, 7, 'Tom', 9, 'Rome', 5)}\n{filler}",
        f"{filler} {filler}",
        QUESTION[:40],
    ]
    got = found(spark, texts, [QUESTION, frames.invented(30, 5)])
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0].changed == 0 and got[0, 0].coverage == 1
    assert got[1, 0].changed == got[1, 0].slots == 7


def test_items_dense_in_numbers_and_short_ones(spark):
    items = [
        "Add 12 km, 15 km, 7 km and 30 km, then subtract 9 km and 4 km.",
        "Find the mean of 3, 8, 12, 15, 20, 21, 25 and 40.",
        "Compute 48 / 6 + 12 * 3 - 5 and then 7 * 9 - 2.",
        "Who wrote the Iliad?",
    ]
    filler = frames.invented(30, 2)
    texts = [f"{filler}. {item} {filler}" for item in items]
    texts += [
        f"{filler}. Add 2 km, 5 km, 8 km and 31 km, then subtract 6 km and 1 km. {filler}",
        f"{filler}. Find the mean of 4, 9, 13, 16, 22, 23, 26 and 41. {filler}",
        f"{filler} 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 km and 11 km or 12 km {filler}",
        f"Compute 47 / 5 + 11 * 2 - 4 and then 6 * 8 - 1. {filler}",
    ]
    assert set(found(spark, texts, items)) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, 1)}


def test_slots_must_be_consistent(spark):
    item = (
        "The red box holds 5 stones and the blue box holds 5 stones and the green box holds 5 stones and "
        "the white box holds 5 stones in total"
    )
    same = item.replace("5", "9")
    mixed = re.sub("5", lambda _, n=iter("1234"): next(n), item)
    assert set(found(spark, [item, same, mixed], [item])) == {(0, 0), (1, 0)}


def test_awkward_rows(spark):
    rows = [(None, QUESTION, "en"), (1, None, "en"), (2, "", "en"), (3, QUESTION, "en"), (3, QUESTION, "en")]
    docs = frames.docs(spark, rows)
    got = D.contaminated(docs, benchmark(spark, [QUESTION, None, "", "too short", QUESTION])).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == [(3, 0), (3, 4), (None, 0), (None, 4)]
    assert D.contaminated(frames.empty(spark), benchmark(spark, [QUESTION])).collect() == []
    assert D.contaminated(docs, benchmark(spark, ["x"]).limit(0)).collect() == []


def test_shuffled_and_broadcast_windows_agree(spark, monkeypatch):
    texts = [f"{frames.invented(20, i)} {QUESTION if i % 3 else ''} {frames.invented(20, -i)}" for i in range(30)]
    broadcast = set(found(spark, texts, [QUESTION]))
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert set(found(spark, texts, [QUESTION])) == broadcast == {(i, 0) for i in range(30) if i % 3}


def brute_force(texts, items):
    """Aligned runs of equal lower-case words, for texts without placeholders."""
    pairs = set()
    for i, text in enumerate(texts):
        words = re.findall(r"[^\W_]+", text.lower())
        for j, item in enumerate(items):
            wanted = re.findall(r"[^\W_]+", item.lower())
            total = len(wanted) - D.WINDOW + 1
            by_shift = {}
            for a in range(len(words) - D.WINDOW + 1):
                for b in range(total):
                    if words[a : a + D.WINDOW] == wanted[b : b + D.WINDOW]:
                        by_shift.setdefault(a - b, set()).add(b)
            if any(len(s) >= D.MIN_WINDOWS or len(s) >= D.COVERAGE * total for s in by_shift.values()):
                pairs.add((i, j))
    return pairs


def test_passages_against_brute_force(spark):
    items = [frames.invented(n, n) for n in (8, 12, 20, 40)]
    texts = []
    for i in range(60):
        words = items[i % 4].split()
        cut = words[i % 5 : len(words) - i % 7]
        texts.append(f"{frames.invented(15, i)} {' '.join(cut)} {frames.invented(15, 99 + i)}")
    assert set(found(spark, texts, items)) == brute_force(texts, items)


def canonical_words(text):
    """Canonical words of a text, their values, and the slots as (number of the word, value)."""
    marked = text
    for pattern, mark in ((D._NUMBER, "0"), (D._UNIT, "0u"), (D._NAME, "0n")):
        marked = regex.sub(pattern, mark, marked)
    words = regex.findall(D._WORD, marked.lower())
    values = [value.lower() for value in regex.findall(f"{D._SLOT}|{D._WORD}", text)]
    places = [i for i, word in enumerate(words) if word in ("0", "0u", "0n")]
    return words, values, list(zip(places, regex.findall(D._SLOT, text), strict=True))


def keyed(words, values, at, length):
    """What must be equal in two windows, and whether it is a template."""
    window = words[at : at + length]
    template = sum(word not in ("0", "0u", "0n") for word in window) >= D.PLAIN
    return tuple(window) if template else ("values", *values[at : at + length]), template


def pairs_by_definition(texts, items):
    pairs = set()
    for i, text in enumerate(texts):
        words, values, slots = canonical_words(text)
        for j, item in enumerate(items):
            wanted, of_item, item_slots = canonical_words(item)
            length = min(D.WINDOW, len(wanted))
            starts = range(len(wanted) - length + 1)
            windows = {(b, *keyed(wanted, of_item, b, length)) for b in starts}
            inside, inside_values = (found[1 : D.WINDOW + 1] for found in canonical_words("x, " + item)[:2])
            if inside != wanted[: D.WINDOW]:
                windows.add((0, *keyed(inside, inside_values, 0, len(inside))))
            n_templates = sum(keyed(wanted, of_item, b, length)[1] for b in starts)
            by_shift = {}
            for a in range(len(words) - length + 1):
                key = keyed(words, values, a, length)[0]
                for b, other, template in windows:
                    if key == other:
                        by_shift.setdefault(a - b, set()).add((b, template))
            for shift, met in by_shift.items():
                at = {b for b, _ in met}
                templates = len({b for b, template in met if template})
                coverage = max(len(at) / len(starts), templates / n_templates if n_templates else 0)
                if len(at) < D.MIN_WINDOWS and coverage < D.COVERAGE:
                    continue
                there, stands_for = dict((place, value) for place, value, *_ in slots), {}
                for place, value in item_slots:
                    if min(at) <= place <= max(at) + D.WINDOW - 1 and place + shift in there:
                        stands_for.setdefault(value, set()).add(there[place + shift])
                if sum(len(v) == 1 for v in stands_for.values()) >= D.CONSISTENT * len(stands_for):
                    pairs.add((i, j))
    return pairs


def test_placeholders_and_slots_against_brute_force(spark):
    chance = random.Random(4)
    parts = ["48", "7", "3.5", "12 km", "9 minutes", "Alice", "Bob", *frames.invented(9, 6).split()]
    items = [" ".join(chance.choices(parts, k=n)) for n in (1, 2, 3, 5, 7, 8, 8, 9, 12, 15, 20, 30)]
    texts = []
    for i in range(120):
        changed = items[i % 12].split()
        for _ in range(chance.randint(0, 4)):
            changed[chance.randrange(len(changed))] = chance.choice(["5", "48", "Carol", "Bob", "km", "lomi", "un"])
        texts.append(f"{frames.invented(9, i)}, {' '.join(changed)} {' '.join(chance.choices(parts, k=9))}")
    expected = pairs_by_definition(texts, items)
    assert set(found(spark, texts, items)) == expected and len(expected) > 100
    # Lengths above and below the window in one table, and the window alone.
    whole = [item for item in items if len(canonical_words(item)[0]) >= D.WINDOW]
    assert set(found(spark, texts, whole)) == pairs_by_definition(texts, whole)


def test_long_text(spark):
    words = frames.invented(150_000, 7)
    assert set(found(spark, [f"{words} {QUESTION} {words}", words], [QUESTION])) == {(0, 0)}


def test_query_judges_rows_that_share_an_identifier_apart(spark, tmp_path):
    filler = frames.invented(30, 3)
    half = len(QUESTION.split()) // 2
    halves = [" ".join(QUESTION.split()[:half]), " ".join(QUESTION.split()[half:])]
    first, second = asked("Maria", 5, 7, "Tom", 9, "Rome", 5), asked("Eva", 8, 2, "Jan", 4, "Oslo", 8)
    rows = [(1, f"{filler} {first}"), (1, f"{second} {filler}"), (None, f"{filler} {second}"), (2, filler)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, QUESTION)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = D.op1_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 0), (1, 0), (1, 0)]

    def whole_items(texts):
        ids = [(None, text) for text in texts]
        frame = spark.createDataFrame(ids, "doc_id bigint, text string")
        return D.contaminated(D.named_by_row(D.located(frame)), benchmark(spark, [QUESTION])).count()

    apart = [f"{filler} {halves[0]}", f"{halves[1]} {filler}"]
    alone = sum(whole_items([text]) for text in apart)
    assert whole_items(apart) == alone
