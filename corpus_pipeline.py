"""From raw documents to packed training sequences, one written stage after another.

Every stage but the last returns rows of `documents` with their columns, whatever their names; each reads all
that the one before kept. Rows are dropped by their place in the table, not by identifier: rows that share
a `doc_id`, or have none, are documents of their own. Of near copies, the one with the smallest `doc_id` stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.llm.common import located, named_by_row, place_columns
from linecensus.llm.decontaminate import contaminated
from linecensus.llm.exact_dedup import exact_dedup
from linecensus.llm.language_id import UNDETERMINED, identify, labelled_sample, train
from linecensus.llm.near_dedup import near_duplicates
from linecensus.llm.packing import pack_documents
from linecensus.session import write_table


def _plain(docs: DataFrame) -> DataFrame:
    """`docs` with columns that no operator's own names can meet; in the same order."""
    names = [name if name in ("doc_id", "text") else f"column {i}" for i, name in enumerate(docs.columns)]
    return docs.toDF(*names)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """`docs`, a located table, without the rows at the places `(file, row)`; a merge join at every size."""
    placed = docs.select("*", *place_columns())
    return placed.join(dropped.distinct().hint("merge"), ["file", "row"], "left_anti").drop("file", "row")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; empty ones and those without a letter go."""
    model = train(labelled_sample(docs))
    plain = _plain(docs)
    found = identify(plain, model, plain.columns).filter(F.col("lang_pred") != UNDETERMINED)
    return found.select(*plain.columns).toDF(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    plain = located(_plain(docs))
    dropped = exact_dedup(plain).filter(~F.col("kept")).select("file", "row")
    return _without(plain, dropped).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by `doc_id` and then by place, of each near-duplicate class."""
    plain = located(_plain(docs))
    dropped = near_duplicates(named_by_row(plain)).filter("doc_id <> class_id").select("doc_id.file", "doc_id.row")
    return _without(plain, dropped).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = located(_plain(docs))
    dropped = contaminated(named_by_row(plain), benchmark).select("doc_id.file", "doc_id.row")
    return _without(plain, dropped).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents with their sequence and offset."""
    return pack_documents(docs)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

# Language identification, near-duplicate detection and packing cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each is written as Parquet and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *filters, (_, last) = STAGES
    for name, stage in filters:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return last(spark, docs, sf_dir)
