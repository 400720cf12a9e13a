import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from linecensus.llm import oracle, queries
from tests.llm import frames
from tests.llm.test_decontaminate import QUESTION, asked
from tests.llm.test_exact_dedup import brute_force as exact_groups
from tests.llm.test_near_dedup import brute_force as near_classes
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """Documents with every kind of row that a stage takes out, and a benchmark."""
    text = frames.invented(120, 1)
    words = text.split()
    rows = [(i, frames.invented(40 + i, 100 + i), "en") for i in range(30)]
    rows += [(100, text, "en"), (101, text + "  ", "en"), (102, " ".join(words[:-1] + ["other"]), "en")]
    rows += [(110, None, "en"), (111, "", "de"), (112, "123 !!", "en")]
    rows += [(120, f"{frames.invented(30, 7)} {asked('Maria', 5, 7, 'Tom', 9, 'Rome', 5)}", "en")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    frame = frame.selectExpr("doc_id", "text", "lang", "'s' AS source", "length(text) AS n_chars")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(0, QUESTION)], "item_id bigint, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_stages_against_brute_force(spark, tables):
    sf_dir, rows = tables
    left = {doc_id: text for doc_id, text, _ in rows if any(c.isalpha() for c in text or "")}
    expected = [set(left)]
    left = {d: left[d] for d, _, _, kept, _ in exact_groups([(d, t) for d, t in left.items()]) if kept}
    expected.append(set(left))
    left = {d: left[d] for d, c in near_classes([(d, t) for d, t in left.items()]) if c == d}
    expected.append(set(left))
    del left[120]
    expected.append(set(left))
    assert expected[1] - expected[2] == {102} and 101 in expected[1]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for (name, stage), ids in zip(C.STAGES[:-1], expected):
        docs = C.write_table(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(ids), name
    packed = C.run(spark, sf_dir)
    assert {r.doc_id for r in packed.collect()} == expected[-1]


def test_rows_are_dropped_not_identifiers(spark, tmp_path):
    """Rows that share an identifier, or have none, are documents of their own."""
    a, b = frames.invented(90, 51), frames.invented(120, 52)
    question = [asked(*values) for values in (("Maria", 5, 7, "Tom", 9, "Rome", 5), ("Eva", 8, 2, "Jan", 4, "Oslo", 8))]
    rows = [
        (5, a), (3, b), (5, f"{b} more"), (None, f"{b} again"), (None, frames.invented(70, 53)),
        (7, f"{frames.invented(40, 54)} {question[0]}"), (7, f"{frames.invented(40, 55)} {question[1]}"),
        (None, f"{frames.invented(40, 56)} {question[0]}"), (7, frames.invented(50, 57)),
    ]
    frame = spark.createDataFrame([(*row, "en", "mine", 1) for row in rows], "doc_id bigint, text string, lang string, score string, row int")
    frame = frame.selectExpr("*", "'x' AS lang_pred", "2 AS file", "text AS __file", "named_struct('file_path', 'f') AS `_metadata`")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, QUESTION)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    left = {2: set(rows), 3: set(rows) - {rows[2], rows[3]}}
    left[4] = left[3] - {rows[5], rows[6], rows[7]}
    for number, (name, stage) in enumerate(C.STAGES[:-1], 1):
        docs = C.write_table(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        found = docs.collect()
        assert {(r.doc_id, r.text) for r in found} == left.get(number, set(rows)), name
        assert {(r.score, r.lang_pred, r["__file"] == r.text, r["_metadata"].file_path) for r in found} == {("mine", "x", True, "f")}


def test_empty_documents(spark, tables, tmp_path):
    sf_dir, _ = tables
    other = tmp_path / "none"
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(other / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(other / "benchmark.parquet"))
    assert C.run(spark, str(other)).collect() == []


def test_one_query_for_each_operator():
    named = list(queries.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in named) == list(range(1, 14))
    assert set(named) | {"pipeline"} <= set(entry.queries())
    assert set(oracle.oracle_sql()) <= set(named)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_its_statement(spark, name):
    assert compare(spark, connect(SF), SF, queries.queries()[name], oracle.oracle_sql()[name]) is None
