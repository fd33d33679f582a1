"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams of a text (ASCII letters in lower case), hashed into a table of
fixed size. Each is scaled by the log ratio of its smoothed counts in toxic and in clean labelled
texts; a logistic regression on the scaled features gives the score (the NB-SVM of Wang and Manning).

The fit reads a bounded sample of labelled rows (``SAMPLE_ROWS`` per class); its counts, its log ratios
and the weights are of fixed size. The intercept is moved by the log ratio of the rates at which the two classes
were drawn, so scores keep the balance of all labels whatever the size of the sample. Scoring reads every whole
text once, without a shuffle.

Edge cases: a null or empty text has no features and gets the score of the intercept; a document without
an id is scored, never used for the fit and never held out; of several labels of one document the
largest counts; without labels of both classes every score is 0. Ties and repeated rows get equal
scores. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.llm.common import SpanHash, Steps, chunks, tidy

SIZES = (3, 4, 5)
BITS = 18
# Most labelled rows per class that the fit reads, and most features it keeps.
SAMPLE_ROWS = 8_000
KEPT_FEATURES = 1 << 12
PENALTY = 2.0
FOLDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    """Weight per hashed n-gram (log ratio times coefficient) and intercept."""

    weights: np.ndarray
    intercept: float
    known: bool


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each document, the sorted distinct hashed n-grams."""
    hashes = SpanHash(_LOWER[data])
    seen = np.zeros(1 << BITS, dtype=bool)
    shift = np.uint64(64 - BITS)
    table = []
    for size in SIZES:
        at = np.arange(max(0, len(data) - size + 1))
        table.append((hashes(at, at + size) >> shift).astype(np.int32))
    for start, stop in zip(offsets[:-1], offsets[1:]):
        for size, codes in zip(SIZES, table):
            seen[codes[start : max(start, stop - size + 1)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def held_out(doc_id="doc_id"):
    """True for the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and class of every labelled document outside the held-out fold."""
    return (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(~held_out())
    )


def drawn_shift(labels: DataFrame, rows: int = SAMPLE_ROWS) -> float:
    """What log-odds learnt from ``labelled_sample`` lack: the log ratio of the rates of clean and toxic labels in it."""
    counts = {r["toxic"]: r["count"] for r in known_labels(labels).groupBy("toxic").count().collect()}
    rates = [min(rows, counts[c]) / counts[c] if counts.get(c) else 1.0 for c in (0, 1)]
    return float(np.log(rates[0]) - np.log(rates[1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts of each class outside the held-out fold."""
    known = known_labels(labels)
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [known.where(F.col("toxic") == c).orderBy(*order).limit(rows) for c in (0, 1)]
    # At most 2 * rows pairs of numbers: a proven size for the broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    empty = Model(np.zeros(1 << BITS, np.float32), 0.0, False)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for _, _, data, offsets in chunks(batch.column("text")):
                found.extend(g.astype(np.int32).tobytes() for g in grams(data, offsets))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())],
                names=["doc_id", "toxic", "grams"],
            )

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        docs_seen = np.zeros(2, np.int64)
        for batch in batches:
            for toxic, one in zip(batch.column("toxic").to_pylist(), batch.column("grams").to_pylist()):
                seen[toxic][np.frombuffer(one, np.int32)] += 1
                docs_seen[toxic] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.record_batch(
            [
                pa.array(np.append(at, -1).astype(np.int32)),
                pa.array(np.append(seen[0][at], docs_seen[0]).astype(np.int64)),
                pa.array(np.append(seen[1][at], docs_seen[1]).astype(np.int64)),
            ],
            names=["gram", "clean", "toxic"],
        )

    steps = Steps(docs.sparkSession, "toxicity")
    schema = "doc_id bigint, toxic int, grams binary"
    rows_in = labelled_sample(docs, labels, rows).select(F.col("doc_id").cast("bigint"), "text", "toxic")
    sample, path = steps.store(rows_in.mapInArrow(tidy(features), schema), "sample")
    total = (
        sample.mapInArrow(tidy(counts), "gram int, clean bigint, toxic bigint")
        .groupBy("gram")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where("gram < 0 OR clean + toxic >= 3")
    ).toArrow()  # at most 2^BITS rows
    gram = total["gram"].to_numpy()
    clean, toxic = (total[c].to_numpy().astype(float) for c in ("clean", "toxic"))
    whole = gram < 0
    n0, n1 = (clean[whole][0], toxic[whole][0]) if whole.any() else (0.0, 0.0)
    if not n0 or not n1:
        steps.remove(path)
        return empty
    gram, clean, toxic = gram[~whole], clean[~whole], toxic[~whole]
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((clean + 1) / (n0 + 2))
    # How much the counts deviate from equal rates, in standard deviations: what the fit keeps.
    pooled = (toxic + clean + 1) / (n0 + n1 + 2)
    strength = np.abs(toxic / n1 - clean / n0) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.999)) * (1 / n0 + 1 / n1))
    best = np.lexsort((gram, -strength))[:KEPT_FEATURES]
    gram, ratio = gram[best], ratio[best]
    place = np.full(1 << BITS, -1, np.int32)
    place[gram] = np.arange(len(gram))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one in batch.column("grams").to_pylist():
                at = place[np.frombuffer(one, np.int32)]
                out.append(at[at >= 0].astype(np.uint16).tobytes())
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())],
                names=["doc_id", "toxic", "grams"],
            )

    # At most 2 * rows short lists of two-byte numbers.
    matrix = sample.mapInArrow(tidy(kept), schema).toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    steps.remove(path)
    lists = [np.frombuffer(x, np.uint16) for x in matrix["grams"].to_pylist()]
    coefficients, intercept = logistic(lists, ratio, matrix["toxic"].to_numpy())
    weights = np.zeros(1 << BITS, np.float32)
    weights[gram] = coefficients * ratio
    return Model(weights, float(intercept) + drawn_shift(labels, rows), True)


def logistic(lists: list[np.ndarray], scale: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient descent; features are scale or 0."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
    value = scale[col]
    n, m = len(lists), len(scale)
    y = y.astype(float)
    norm = np.ones(m) / np.sqrt(m)
    for _ in range(20):  # the largest eigenvalue bounds the step
        image = np.bincount(row, value * norm[col], n)
        norm = np.bincount(col, value * image[row], m)
        top = float(np.linalg.norm(norm)) or 1.0
        norm /= top
    rate = 1.0 / (0.25 * top / n + 0.25 + PENALTY / n)
    w, b = np.zeros(m), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * v[col], n) + c, -30, 30)))
        residual = (p - y) / n
        new_w = v - rate * (np.bincount(col, value * residual[row], m) + PENALTY / n * v)
        new_b = c - rate * residual.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w, b


def logits(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    """Of every text of a batch; below any threshold where there is no model."""
    if not model.known:
        return np.full(batch.num_rows, -np.inf)
    out = [
        model.weights[g].sum(dtype=np.float64)
        for _, _, data, offsets in chunks(batch.column("text"))
        for g in grams(data, offsets)
    ]
    return np.array(out, np.float64) + model.intercept


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (score >= 0.5) of every document; its other columns stay away."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = 1 / (1 + np.exp(-np.clip(logits(batch, model), -700, 500)))
            value = value if model.known else np.zeros(len(value))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    return docs.select("doc_id", "text").mapInArrow(tidy(scored), schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels, rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, all columns as they were, without those that are predicted toxic."""
    model = fit(docs, labels, rows)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(logits(batch, model) < 0, pa.bool_()))

    return docs.mapInArrow(tidy(clean), docs.schema)
