import random
import re

import pytest

from linecensus.llm import pii as I
from tests.llm import frames

# The plain patterns, and what a match must fulfil besides.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute_force(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    ]


def spans(row, base=True):
    return [(s.kind, s.start, s.end) for s in row.spans if s.base == base]


def test_base_spans_against_brute_force(spark):
    chance = random.Random(8)
    parts = [
        "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "001.002.003.255", "a.b%c@d-e.f.g",
        "x@y", "@z.com", "_q@r.st", "+1 (499) 555-6503", "+12", "+1 2 3", "5", "-", " ", ".", "\n", "é", "日", "𝒳", "+",
        "@", "word", "1.2.3.4.5.6.7.8", "9" * 25, "00", "(", ")",
    ]
    texts = ["".join(chance.choice(parts) for _ in range(chance.randint(0, 12))) for _ in range(1500)]
    docs = frames.docs(spark, [(i, text, "en") for i, text in enumerate(texts)])
    for row in I.find_pii(docs).collect():
        assert spans(row) == brute_force(texts[row.doc_id]), texts[row.doc_id]


def test_awkward_rows(spark):
    mail = "write to a@b.com"
    rows = [(None, mail, "en"), (1, None, "en"), (2, "", "en"), (3, mail, "en"), (3, mail, "en"), (4, "1" * 50_000, "en")]
    found = I.find_pii(frames.docs(spark, rows)).collect()
    got = sorted(((r.doc_id, spans(r)) for r in found), key=repr)
    assert got == sorted(((doc_id, brute_force(text)) for doc_id, text, _ in rows), key=repr)
    assert I.find_pii(frames.empty(spark)).collect() == []
    none = I.find_pii(frames.docs(spark, [(1, "nothing here", "en")])).collect()
    assert [(r.doc_id, r.spans) for r in none] == [(1, [])]


@pytest.mark.parametrize("every", [1000, 20, 3])
def test_written_out_addresses_are_found_however_common(spark, every):
    rows = []
    for i in range(3000):
        sign = (" (at) ", "[at]", " at ")[i // every % 3] if i % every == 0 else "@"
        dot = " dot " if sign == " at " else "."
        rows.append((i, f"please send it to user{i}{sign}mail{i % 9}.example{dot}com , or look at notes.txt now", "en"))
    rows += [(10_000 + i, f"we met at hall{i % 7}.north for lunch", "en") for i in range(500)]
    found = {r.doc_id: r for r in I.find_pii(frames.docs(spark, rows, clashing=False)).collect()}
    for i, text, _ in rows:
        added = spans(found[i], base=False)
        if i < 3000 and i % every == 0:
            start = text.index("user")
            assert added == [("email", start, text.index(" ,"))]
        else:
            assert added == []


@pytest.mark.parametrize("every", [200, 20, 3])
def test_numbers_after_a_keyword_are_found_and_other_digits_refused(spark, every):
    forms = ["(555) 01{:02}-4567", "0555 01{:02} 4567", "555.01{:02}.4567"]
    others = ["order 20{:02}-1234-5678", "on 2024-05-{:02} 2025-01-02", "sum 12{:02}.5000 / 3000", "no. 99{:02}1234567"]
    rows, wanted = [], {}
    for i in range(3000):
        if i % every == 0:
            value = forms[i // every % 3].format(i % 90 + 10)
            rows.append((i, f"Phone: {value}, daily", "en"))
            wanted[i] = [("phone", 7, 7 + len(value))]
        else:
            rows.append((i, f"see {others[i % 4].format(i % 20 + 10)} there", "en"))
    found = {r.doc_id: r for r in I.find_pii(frames.docs(spark, rows, clashing=False)).collect()}
    for i, text, _ in rows:
        assert spans(found[i], base=False) == wanted.get(i, []), text


def test_bracketed_addresses_of_hosts_and_grouped_cards(spark):
    rows = [
        (1, "host 10[.]0[.]0[.]1 and 10.0.0.2 up", "en"),
        (2, "at 10 dot 0 dot 0 dot 7 now, not 300[.]1[.]1[.]1", "en"),
        (3, "card 4111.1111.1111.1111 or 4111.1111.1111.1112", "en"),
        (4, "5551234567 (at) mail.example.com", "en"),
    ]
    found = {r.doc_id: r for r in I.find_pii(frames.docs(spark, rows)).collect()}
    text = {doc_id: text for doc_id, text, _ in rows}
    assert [text[1][s:e] for _, s, e in spans(found[1], base=False)] == ["10[.]0[.]0[.]1"]
    assert [text[2][s:e] for _, s, e in spans(found[2], base=False)] == ["10 dot 0 dot 0 dot 7"]
    assert [text[3][s:e] for _, s, e in spans(found[3], base=False)] == ["4111.1111.1111.1111"]
    assert spans(found[4], base=False) == [("email", 0, len(text[4]))]


def test_spans_inside_better_ones_go(spark):
    schema = "row bigint, source string, base boolean, start int, end int, score double"
    rows = [
        (1, "address", False, 0, 20, 2.0), (1, "digits", False, 3, 9, 1.0), (1, "digits", False, 12, 25, 1.0),
        (1, "quad", False, 0, 20, 1.0), (2, "digits", False, 3, 9, 1.0), (2, "address", False, 0, 20, 1.0),
        (3, "email", True, 2, 4, 0.0), (3, "address", False, 0, 9, 5.0),
    ]
    kept = spark.createDataFrame(rows, schema).withColumn("gone", I._inside_better()).filter("NOT gone")
    want = [(1, 0, 20), (1, 12, 25), (2, 0, 20), (2, 3, 9), (3, 0, 9), (3, 2, 4)]
    assert sorted((r.row, r.start, r.end) for r in kept.collect()) == want


def test_groups_weigh_the_same():
    x, y = (0,) * len(I.FEATURES), (1,) * len(I.FEATURES)
    cells = I.balanced([[(x, 1e9)], [(y, 3.0)], [(x, 1.0), (y, 1.0)]], [True, True, False])
    assert [n for _, n, _ in cells] == [I.WEIGHT, I.WEIGHT, I.WEIGHT / 2, I.WEIGHT / 2]
    assert [p for *_, p in cells] == [I.WEIGHT, I.WEIGHT, 0, 0]
    start, trees = I.boost(cells)  # and nothing overflows
    assert len(trees) > 0 or start > 0


def test_trees_learn_an_interaction():
    width = len(I.FEATURES)
    cells = []
    for a in (0, 1):
        for b in (0, 1):
            x = tuple([a, b] + [0] * (width - 2))
            n = 100.0 + 10 * a  # a little uneven, as an exact balance has no first split
            cells.append((x, n, n * (a != b)))
    start, trees = I.boost(cells)
    score = {x[:2]: start + sum(I.value_of(tree, x) for tree in trees) for x, _, _ in cells}
    assert min(score[0, 1], score[1, 0]) > 1 > -1 > max(score[0, 0], score[1, 1])
    limits = I.thresholds(cells, start, trees)
    assert score[0, 0] < limits["email"] <= score[0, 1]


def test_scores_of_columns_and_of_python_agree(spark):
    chance = random.Random(1)
    cells = []
    for _ in range(60):
        x = tuple(chance.randint(0, 3) for _ in I.FEATURES)
        n = float(chance.randint(1, 30))
        cells.append((x, n, float(chance.randint(0, int(n)))))
    start, trees = I.boost(cells)
    frame = spark.createDataFrame([x for x, _, _ in cells], ", ".join(f"{name} int" for name in I.FEATURES))
    scored = frame.select(*I.FEATURES, I.score_column(start, trees).alias("s")).collect()
    for row in scored:
        assert abs(row.s - start - sum(I.value_of(t, tuple(row)[:-1]) for t in trees)) < 1e-9
