"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base patterns of e-mail addresses, IP addresses, payment cards and telephone numbers give spans that are always
redacted. High-recall generators propose more spans that may overlap them and each other: addresses and IP
addresses with written-out or bracketed signs, and digits in any grouping. All candidates are described by
format and context features that take a few values each. Boosted two-level trees are fitted on the counts
of every combination of values over the whole table (a table bounded by the features, not by the data), on four
folds of documents. Positive are base spans and proposals with evidence of their own: their normalised form
passes a base pattern and its check, and they are written as such data is (a bracketed sign, card groups, a
keyword before a number). Base spans, proposals with evidence and the others have equal weight, so it does not
matter how common a form is. The fifth fold calibrates a threshold for each kind: the lowest score above
which the share of proposals with evidence is at least `PRECISION` (all folds do where the fifth has no proposal of
the kind). Proposals that reach it are added, but for those inside a proposal of higher score and those that
overlap a base span of their own kind, which is the same find.

Positions are code points, found from the lengths of the gaps between matches; patterns never
match across a line, and possessive quantifiers keep them linear in the text.

- A null text counts as empty and has no span.
- Repeated rows and rows with the same `doc_id` are treated one by one; a null `doc_id` is passed through.
- A table without any proposal adds nothing. An empty table gives an empty result.
- Only `doc_id` and `text` are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecensus.llm.common import held_out, text_or_empty
from linecensus.session import write_table

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
TREES = 20
RATE = 0.3
# Total weight of base spans, of proposals with evidence and of the others; largest value of a leaf.
WEIGHT, STEP = 1000.0, 4.0

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A match begins where a run of characters does or where the match before it ends, which spares
# later starts inside a run; both give the leftmost matches of the plain patterns.
_RUN = rf"(?:(?<!{_LOCAL})|\G)"
BASE = {
    "email": rf"{_RUN}{_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT = r"(?:@| ?[\[({] ?at ?[\])}] ?| at )"
_DOT = r"(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )"
_PERIOD = r"(?:\.| ?[\[({] ?(?:\.|dot) ?[\])}] ?| dot )"
GENERATORS = {
    "address": rf"(?i)(?<!{_LOCAL}){_LOCAL}++{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++",
    "digits": r"(?<![0-9])\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}+",
    "quad": rf"(?i)(?<![0-9])[0-9]{{1,3}}+(?:{_PERIOD}[0-9]{{1,3}}+){{3}}(?![0-9])",
}
_GUARDS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][ -]?[0-9]",
    "phone": r"\+[0-9]",
    "address": r"(?i)@|[\[({] ?at ?[\])}]| at ",
    "digits": r"[0-9]",
    "quad": r"(?i)[0-9] ?[\[({ ] ?(?:\.|dot)",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
# Words that announce personal data shortly before it, by kind.
_KEYWORDS = {
    "phone": "tel|phone|telephone|telefon|telefono|teléfono|téléphone|call|fax|mobile|cell|handy|whatsapp",
    "email": "mail|e-mail|email|contact|write|kontakt|correo|courriel",
    "card": "card|visa|mastercard|karte|carte|tarjeta",
    "ip": "ip|host|address|server",
}
_DATE = r"^(?:(?:19|20)[0-9]{2}[./ -][0-9]{1,2}[./ -][0-9]{1,2}|[0-9]{1,2}[./ -][0-9]{1,2}[./ -](?:19|20)[0-9]{2})(?![0-9])"
_CARD = r"^[0-9]{4}(?:[ ./-]{0,2}[0-9]{4}){3}[0-9]{0,3}$"
_BRACKETED_AT = r"(?i)[\[({] ?at ?[\])}]"
_WRITTEN_DOT = r"(?i)[\[({] ?dot ?[\])}]| dot "


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string is right."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    total = F.aggregate(doubled, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def _is_base(source: Column, value: Column) -> Column:
    digits = _digits(value)
    length = F.char_length(digits)
    ip = value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    return (
        F.when(source == "email", True)
        .when(source == "ip", ip)
        .when(source == "card", F.when(length.between(16, 19), luhn(digits)).otherwise(False))
        .when(source == "phone", length.between(8, 15))
        .otherwise(False)
    )


def _matches(source: str, pattern: str) -> Column:
    """Gaps and matches of a pattern in turn; the last gap has no match."""
    text = text_or_empty()
    found = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda gap, value: F.struct(
            F.lit(source).alias("source"),
            F.char_length(gap).alias("gap"),
            value.alias("value"),
            F.left(gap, F.lit(1)).alias("head"),
            F.right(gap, F.lit(24)).alias("tail"),
        ),
    )
    return F.when(text.rlike(_GUARDS[source]), found).otherwise(F.array().cast(_MATCHES))


_MATCHES = "array<struct<source:string,gap:int,value:string,head:string,tail:string>>"


def candidates(docs: DataFrame) -> DataFrame:
    """Base and proposed spans with features, and one row without a span (null `kind`) per document.

    `row` tells apart documents of equal `doc_id`.
    """
    every = F.concat(*[_matches(source, pattern) for source, pattern in (BASE | GENERATORS).items()])
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.select("row", "doc_id", F.posexplode_outer(every).alias("n", "m")).select(
        "row", "doc_id", "n", "m.*"
    )
    rows = write_table(rows, "pii-matches")
    one = rows.select("row", "doc_id").distinct()
    order = Window.partitionBy("row", "source").orderBy("n")
    length = F.char_length("value")
    spans = rows.filter("source IS NOT NULL").withColumns(
        {
            "next": F.lead("head").over(order),
            "end": F.sum(F.col("gap") + F.coalesce(length, F.lit(0))).over(order),
        }
    )
    spans = spans.filter("value IS NOT NULL").withColumn("start", F.col("end") - length)
    spans = spans.withColumn("base", _is_base(F.col("source"), F.col("value")))
    spans = spans.filter(F.col("base") | F.col("source").isin(*GENERATORS))
    spans = spans.withColumn("digits", _digits(F.col("value")))
    count = F.char_length("digits")
    kind = (
        F.when(F.col("source") == "address", "email")
        .when(F.col("source") == "quad", "ip")
        .when(F.col("source") != "digits", F.col("source"))
        .when(count.between(16, 19), "card")
        .when(count.between(8, 15), "phone")
    )
    spans = spans.withColumn("kind", kind).filter("kind IS NOT NULL")
    spans = spans.withColumns({"same": _meets_base("row", "kind"), "over": _meets_base("row")})
    spans = spans.filter("base OR NOT same").withColumns(_features())
    spans = spans.withColumn("evident", ~F.col("base") & _is_evident())
    spans = spans.select("row", "doc_id", "source", "kind", "start", "end", "base", "evident", *FEATURES)
    return one.withColumn("kind", F.lit(None).cast("string")).unionByName(spans, allowMissingColumns=True)


def _meets_base(*group: str) -> Column:
    """Whether a span overlaps another one, a base span, of its group."""
    order = Window.partitionBy(*group).orderBy("start", "end", "source")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return (F.coalesce(ended, F.lit(-1)) > F.col("start")) | (F.coalesce(begun, F.col("end")) < F.col("end"))


FEATURES = (
    "f_kind", "f_digits", "f_groups", "f_luhn", "f_tail", "f_local", "f_before", "f_after", "f_word", "f_form",
    "f_sign", "f_over",
)


def _is_evident() -> Column:
    """Whether the normalised form of a proposal passes a base pattern, and how it is written speaks for it."""
    value, announced = F.col("value"), F.col("f_word") == 1
    address = F.regexp_replace(F.regexp_replace(value, f"(?i){_AT}", "@"), f"(?i){_DOT}", ".")
    whole = address.rlike(rf"^{_LOCAL}+@{_LABEL}+(?:\.{_LABEL}+)*\.[A-Za-z]{{2,6}}$")
    quad = F.regexp_replace(value, "[^0-9]+", ".").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    return (
        F.when(F.col("kind") == "email", whole & (F.col("f_sign").isin(1, 2, 3) | announced))
        .when(F.col("kind") == "ip", quad)
        .when(F.col("over"), False)
        .when(F.col("kind") == "card", (F.col("f_luhn") == 1) & (F.col("f_form") == 2))
        .otherwise(announced & (F.col("f_form") != 3))
    )


def _features() -> dict[str, Column]:
    """Format and context as small whole numbers."""
    value, digits = F.col("value"), F.col("digits")
    count = F.char_length(digits)
    email = F.col("kind") == "email"
    last = F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)

    def side(char: Column) -> Column:
        return (
            F.when((F.coalesce(char, F.lit("")) == "") | char.rlike(r"\s"), 0)
            .when(char.rlike(r"\p{L}"), 1)
            .when(char.rlike(r"\p{N}"), 2)
            .otherwise(3)
        )

    groups = F.size(F.split(F.regexp_replace(value, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+"))
    form = (
        F.when(value.rlike(r"^(?:\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$"), 1)
        .when(value.rlike(_CARD), 2)
        .when(value.rlike(_DATE), 3)
        .otherwise(0)
    )
    sign = (
        F.when(~email, value.rlike("[^0-9.]").cast("int"))
        .when(value.rlike(_BRACKETED_AT), 1)
        .when(value.contains("@"), F.when(value.rlike(_WRITTEN_DOT), 2).otherwise(0))
        .when(value.rlike(_WRITTEN_DOT), 3)
        .otherwise(4)
    )
    announced = F.lit(False)
    for kind, words in _KEYWORDS.items():
        before = F.col("tail").rlike(rf"(?iu)(?<!\p{{L}})(?:{words})(?!\p{{L}})")
        announced = F.when(F.col("kind") == kind, before).otherwise(announced)
    found = {
        "f_kind": F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1,
        "f_digits": F.when(email, F.least(count, F.lit(3))).otherwise(count),
        "f_groups": F.when(email, 0).otherwise(F.least(groups, F.lit(6))),
        "f_luhn": F.when(F.col("kind") == "card", luhn(digits).cast("int")).otherwise(0),
        "f_tail": F.when(email & last.rlike("^[A-Za-z]+$"), F.least(F.char_length(last), F.lit(5))).otherwise(0),
        "f_local": F.when(email, value.rlike("^[^ @\\[({]*[0-9._]").cast("int")).otherwise(0),
        "f_before": side(F.right("tail", F.lit(1))),
        "f_after": side(F.col("next")),
        "f_word": announced,
        "f_form": form,
        "f_sign": sign,
        "f_over": F.col("over"),
    }
    return {name: column.cast("int") for name, column in found.items()}


# A tree: feature and bound of the root, then those of each side (None: no further split) with values.
Leaf = tuple[float, float]
Side = tuple[int | None, int, Leaf]
Tree = tuple[int, int, Side, Side]
Cell = tuple[tuple[int, ...], float, float]


def _split(cells: list[tuple[tuple[int, ...], float, float]]) -> tuple[float, int, int] | None:
    """Best `(gain, feature, bound)`: values up to the bound go left. Cells are `(x, gradient, curvature)`."""
    whole_g = sum(c[1] for c in cells)
    whole_h = sum(c[2] for c in cells)
    best = None
    for feature in range(len(FEATURES)):
        sums: dict[int, list[float]] = {}
        for x, g, h in cells:
            held = sums.setdefault(x[feature], [0.0, 0.0])
            held[0] += g
            held[1] += h
        left_g = left_h = 0.0
        for bound in sorted(sums)[:-1]:
            left_g += sums[bound][0]
            left_h += sums[bound][1]
            gain = (
                left_g**2 / (left_h + 1)
                + (whole_g - left_g) ** 2 / (whole_h - left_h + 1)
                - whole_g**2 / (whole_h + 1)
            )
            if best is None or gain > best[0]:
                best = gain, feature, bound
    return best


def _leaf(cells: Iterable[tuple[tuple[int, ...], float, float]]) -> float:
    g = h = 0.0
    for _, a, b in cells:
        g, h = g + a, h + b
    return max(-STEP, min(STEP, -RATE * g / (h + 1)))


def _side(cells: list[tuple[tuple[int, ...], float, float]]) -> Side:
    found = _split(cells)
    if not found or found[0] < 1e-6:
        return None, 0, (_leaf(cells),) * 2
    _, feature, bound = found
    parts = [c for c in cells if c[0][feature] <= bound], [c for c in cells if c[0][feature] > bound]
    return feature, bound, (_leaf(parts[0]), _leaf(parts[1]))


def boost(cells: list[Cell]) -> tuple[float, list[Tree]]:
    """Start value and trees fitted on cells `(features, candidates, positive ones)`."""
    total, positive = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = log((positive + 0.5) / (total - positive + 0.5))
    scores = [start] * len(cells)
    trees: list[Tree] = []
    for _ in range(TREES):
        chances = [1 / (1 + exp(-s)) for s in scores]
        fitted = [(x, n * p - y, n * p * (1 - p)) for (x, n, y), p in zip(cells, chances)]
        found = _split(fitted)
        if not found or found[0] < 1e-6:
            break
        _, feature, bound = found
        left = _side([c for c in fitted if c[0][feature] <= bound])
        right = _side([c for c in fitted if c[0][feature] > bound])
        trees.append((feature, bound, left, right))
        scores = [s + value_of(trees[-1], x) for s, (x, _, _) in zip(scores, cells)]
    return start, trees


def value_of(tree: Tree, x: tuple[int, ...]) -> float:
    feature, bound, left, right = tree
    inner, at, values = left if x[feature] <= bound else right
    return values[0] if inner is None or x[inner] <= at else values[1]


def score_column(start: float, trees: list[Tree]) -> Column:
    """The boosted score as one expression over the feature columns."""

    def side(part: Side) -> Column:
        inner, at, values = part
        if inner is None:
            return F.lit(values[0])
        return F.when(F.col(FEATURES[inner]) <= at, values[0]).otherwise(values[1])

    total = F.lit(start)
    for feature, bound, left, right in trees:
        total = total + F.when(F.col(FEATURES[feature]) <= bound, side(left)).otherwise(side(right))
    return total


def balanced(groups: list[list[tuple[tuple[int, ...], float]]], positive: list[bool]) -> list[Cell]:
    """Cells of groups `(features, candidates)`, every group with the same total weight."""
    cells = []
    for group, label in zip(groups, positive):
        total = sum(n for _, n in group)
        cells += [(x, n * WEIGHT / total, label * n * WEIGHT / total) for x, n in group if n]
    return cells


def thresholds(cells: list[Cell], start: float, trees: list[Tree]) -> dict[str, float]:
    """For each kind the lowest score with the wanted precision on calibration cells; kinds without one are left out."""
    found: dict[str, float] = {}
    for number, kind in enumerate(KINDS):
        scored: dict[float, list[float]] = {}
        for x, n, y in cells:
            if x[0] == number:
                score = round(start + sum(value_of(tree, x) for tree in trees), 9)
                held = scored.setdefault(score, [0.0, 0.0])
                held[0] += n
                held[1] += y
        total = positive = 0.0
        for score in sorted(scored, reverse=True):
            total += scored[score][0]
            positive += scored[score][1]
            if positive >= PRECISION * total:
                found[kind] = score - 1e-6
    return found


def _inside_better() -> Column:
    """Whether a proposal lies inside one of another generator with a higher score.

    The matches of one generator do not overlap, so only its last one that begins no later can hold the span.
    """
    order = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.lit(False)
    for source in GENERATORS:
        other = F.when(F.col("source") == source, F.struct("start", "end", "score"))
        other = F.max(other).over(order)
        better = (other["end"] >= F.col("end")) & (other["score"] > F.col("score"))
        inside = inside | ((F.col("source") != source) & F.coalesce(better, F.lit(False)))
    return ~F.col("base") & inside


def find_pii(docs: DataFrame) -> DataFrame:
    """`(doc_id, spans)` of each row; a span has `kind`, `start`, `end` and `base`, in the order of KINDS and starts."""
    found = write_table(candidates(docs), "pii-candidates")
    base, evident = F.col("base").cast("int"), F.col("evident").cast("int")
    counted = (
        found.filter("kind IS NOT NULL")
        .groupBy(held_out(F.col("doc_id")).alias("aside"), *FEATURES)
        .agg(F.count("*").alias("n"), F.sum(base).alias("base"), F.sum(evident).alias("evident"))
    )
    # At most as many rows as there are combinations of feature values.
    groups: list[list[tuple[tuple[int, ...], float]]] = [[], [], []]
    proposed: dict[bool, list[Cell]] = {True: [], False: []}
    for row in counted.orderBy("aside", *FEATURES).collect():
        x, others = tuple(row[name] for name in FEATURES), row.n - row.base
        if others:
            proposed[row.aside].append((x, float(others), float(row.evident)))
        if not row.aside:
            for group, n in zip(groups, (row.base, row.evident, others - row.evident)):
                group.append((x, float(n)))
    cells = balanced(groups, [True, True, False])
    start, trees = boost(cells) if cells else (0.0, [])
    seen = {x[0] for x, _, _ in proposed[True]}
    aside = proposed[True] + [cell for cell in proposed[False] if cell[0][0] not in seen]
    limit = F.lit(None).cast("double")
    for kind, value in thresholds(aside, start, trees).items():
        limit = F.when(F.col("kind") == kind, value).otherwise(limit)
    scored = found.filter("kind IS NOT NULL").withColumn("score", score_column(start, trees))
    # A missing limit makes this null, and nothing of the kind is added.
    taken = scored.filter(F.coalesce(F.col("base") | (F.col("score") >= limit), F.lit(False)))
    taken = taken.withColumn("inside", _inside_better()).filter("NOT inside")
    columns = ("row", "doc_id", "kind", "start", "end", "base")
    every = found.filter("kind IS NULL").select(*columns).unionByName(taken.select(*columns))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct(number.alias("number"), "start", "end", "base", "kind"))
    # The number of spans of one document.
    return every.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("row")


def _joined(spans: Column) -> Column:
    one = F.transform(
        spans,
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(one, ",")


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        number = F.size(F.filter("spans", lambda s: s["kind"] == kind))
        return number.cast("bigint").alias(f"n_{kind}")

    base = _joined(F.filter("spans", lambda s: s["base"]))
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
