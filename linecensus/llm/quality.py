"""Quality classifier on random-indexing word vectors.

Every word has a sparse random index vector (a few signs at places given by its hash). The vector
of a word is the sum of the index vectors of its neighbours in the training texts; words share
`BUCKETS` hash buckets, so the table of vectors has a fixed size and no word is unknown. A document is the
mean of its words' vectors, together with the mean of their own index vectors and simple shares of
character kinds. A two-layer network, trained with numpy, gives a logit; a temperature fitted on a
part of the labelled rows that the network has not seen calibrates it into a probability.

Labelled rows are a bounded sample: the `ROWS` rows with the smallest hash of their identifier that
are not held out. Their texts are read whole on the executors; only sums and features reach the driver.

- A null text counts as empty; empty texts get the score of a document without words.
- Labels that are null, and labelled ids without a document, are not used.
- With no label or a single class the score is the share of label 1 (0.5 without any).
- A null `doc_id` and repeated rows are scored like any other; extra columns are ignored.
- An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.llm.common import held_out
from linecensus.llm.token_counts import blocks
from linecensus.session import write_table

ROWS = 6000
BUCKETS = 1 << 14
DIMENSIONS = 48
SIGNS = 4
WINDOW = 2
HIDDEN = 24
EPOCHS = 400
CALIBRATION_PART = 5  # one labelled row in five calibrates
THRESHOLD = 0.3
WORDS = re.compile(r"\w+|[^\w\s]+")
_SHARES = 5


class Buckets(dict):
    """Hash bucket of a word; forgotten all at once when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        bucket = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return bucket


_BUCKETS = Buckets()


def index_vectors() -> np.ndarray:
    """The random index vectors of all buckets; the same on every machine."""
    rng = np.random.default_rng(7)
    table = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    places = rng.integers(0, DIMENSIONS, (BUCKETS, SIGNS))
    signs = rng.choice(np.array([-1, 1], np.float32), (BUCKETS, SIGNS))
    np.add.at(table, (np.arange(BUCKETS)[:, None], places), signs)
    return table / np.sqrt(SIGNS)


def word_blocks(text: str):
    """Buckets of the text's words and its counts of character kinds, block by block."""
    for block in blocks(text):
        words = WORDS.findall(block)
        ids = np.fromiter(map(_BUCKETS.__getitem__, words), np.int32, len(words))
        upper = sum(map(str.isupper, words))
        marks = sum(len(w) for w in words if not (w[0].isalnum() or w[0] == "_"))
        repeated = np.count_nonzero(ids[1:] == ids[:-1])
        yield ids, np.array([len(words), upper, marks, len(set(words)), repeated], np.float64)


def neighbour_sums(texts, index: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of neighbours, per bucket."""
    sums = np.zeros_like(index)
    for text in texts:
        for ids, _ in word_blocks(text or ""):
            for distance in range(1, WINDOW + 1):
                left, right = ids[:-distance], ids[distance:]
                np.add.at(sums, left, index[right])
                np.add.at(sums, right, index[left])
    return sums


def features(text: str | None, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Pooled vectors and shares of one whole text."""
    pooled = np.zeros(2 * DIMENSIONS)
    counts = np.zeros(_SHARES)
    for ids, kinds in word_blocks(text or ""):
        counts += kinds
        used = np.bincount(ids, minlength=1)
        places = np.flatnonzero(used)
        weight = used[places].astype(np.float32)
        pooled[:DIMENSIONS] += weight @ vectors[places]
        pooled[DIMENSIONS:] += weight @ index[places]
    words = max(1.0, counts[0])
    shares = np.minimum(counts[1:] / words, 5)
    return np.r_[pooled / words, np.log1p(counts[0]) / 10, shares]


class Network:
    """Word vectors, two layers and the temperature."""

    def __init__(self, vectors: np.ndarray, index: np.ndarray, prior: float):
        self.vectors, self.index, self.prior = vectors, index, prior
        self.weights = None
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        # Rounded, as the last bits depend on how rows are batched.
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50))), 9)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 1) -> None:
        """Full-batch Adam on the cross entropy, with a small weight penalty."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng = np.random.default_rng(seed)
        z = (x - self.mean) / self.scale
        weights = [
            rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, HIDDEN**-0.5, HIDDEN),
            np.zeros(()),
        ]
        first, second = [[np.zeros_like(w) for w in weights] for _ in range(2)]
        for step in range(1, EPOCHS + 1):
            w1, b1, w2, b2 = weights
            hidden = np.tanh(z @ w1 + b1)
            error = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -50, 50))) - y
            back = (error[:, None] * w2) * (1 - hidden**2)
            gradients = [z.T @ back, back.sum(axis=0), hidden.T @ error, error.sum()]
            for i, gradient in enumerate(gradients):
                gradient = gradient / len(y) + 1e-3 * weights[i]
                first[i] = 0.9 * first[i] + 0.1 * gradient
                second[i] = 0.999 * second[i] + 0.001 * gradient**2
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[i] = weights[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)
        self.weights = weights

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the smallest cross entropy on rows the network has not seen."""
        logits = self.logits(x)

        def loss(temperature: float) -> float:
            z = np.clip(logits / temperature, -50, 50)
            return float(np.mean(np.logaddexp(0, z) - y * z))

        self.temperature = min(np.geomspace(0.2, 10, 60), key=loss)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(doc_id, text, quality)` of at most `ROWS` labelled rows, chosen by hash."""
    usable = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS)
    # Its size is bounded by ROWS.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> Network:
    spark = docs.sparkSession
    sample = write_table(labelled_sample(docs, labels), "quality-sample")
    index = index_vectors()

    def add(batches):
        import pyarrow as pa

        sums = np.zeros((BUCKETS, DIMENSIONS), np.float32)
        table = index_vectors()
        for batch in batches:
            sums += neighbour_sums(batch.column("text").to_pylist(), table)
        # Only the buckets that occur.
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        vectors = pa.array(list(sums[used]), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), vectors], ["bucket", "vector"])

    partial = sample.select("text").mapInArrow(add, "bucket int, vector array<float>")
    added = partial.select("bucket", F.posexplode("vector").alias("d", "v"))
    added = added.groupBy("bucket").agg(
        *[F.sum(F.when(F.col("d") == d, F.col("v"))).cast("float").alias(f"v{d}") for d in range(DIMENSIONS)]
    )
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for row in added.collect():  # at most BUCKETS rows
        vectors[row[0]] = row[1:]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    shared = spark.sparkContext.broadcast((vectors, index))

    def pool(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [features(text, *shared.value) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))],
                ["doc_id", "quality", "x"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in sample.schema}
    schema = f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, x array<double>"
    pooled = sample.select("doc_id", "quality", "text").mapInArrow(pool, schema)
    rows = sorted(pooled.collect(), key=lambda r: (r.doc_id, r.quality, r.x))  # at most ROWS rows
    y = np.array([float(row.quality == 1) for row in rows])
    network = Network(vectors, index, float(y.mean()) if len(y) else 0.5)
    if 0 < y.sum() < len(y):
        x = np.array([row.x for row in rows])
        aside = np.arange(len(rows)) % CALIBRATION_PART == 0
        if 0 < y[~aside].sum() < (~aside).sum():
            network.fit(x[~aside], y[~aside])
            network.calibrate(x[aside], y[aside])
    return network


def score_quality(docs: DataFrame, network: Network) -> DataFrame:
    """`(doc_id, score)` of each document; the network has a fixed size and goes to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            model = shared.value
            rows = [features(t.as_py(), model.vectors, model.index) for t in batch.column("text")]
            scores = model.score(np.array(rows)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, network).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
