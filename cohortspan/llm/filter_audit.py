"""How filters interact: what each removes in every order, from one walk over the subsets of filters.

Every document gets a mask with one bit per filter that it fails. Documents with equal masks are one cell, so
a part of the corpus is at most 2^f cells however many documents it holds. The subsets of filters are visited
in Gray-code order, one filter toggled at a time: each cell keeps the number of active filters that it fails,
and the running survivors change only by the cells whose number leaves or reaches zero. The survivors of all
2^f subsets are stored (32 states for five filters); what a filter removes behind others is the difference of
two states, so no order is ever run.

The scan judges each text on its own. Whether a text was seen before needs the whole table: texts meet by their
SHA-256, the least id of each is found by partial aggregation, and ids are compared in a join that has one row
per text on its other side.

Edge cases: a null text is empty, a null part is the empty string. A document without an id passes the copy
filter and makes no other fail. Rows that repeat an id count each, and as an equal id is not a smaller one, none
of them is the other's copy. Of several labels of one document the largest counts; labels without an id count
nowhere. An empty table has no parts and so no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.llm.common import Steps, tidy

MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = re.compile(rb"[#$%&*|]")


def too_short(raw: bytes, words: list[bytes]) -> bool:
    return len(words) < MIN_WORDS


def too_repetitive(raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < DISTINCT_PERCENT * len(words)


def code_points(raw: bytes) -> int:
    """Bytes that do not continue a UTF-8 sequence."""
    return int(np.count_nonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80))


def too_many_capitals(raw: bytes, words: list[bytes]) -> bool:
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return 100 * capitals > CAPITAL_PERCENT * code_points(raw)


def holds_symbols(raw: bytes, words: list[bytes]) -> bool:
    return _SYMBOLS.search(raw) is not None


# Name and condition of the filters that see one text: its bytes and its words, which end at ASCII white space.
TEXT_FILTERS = {"A": too_short, "B": too_repetitive, "C": too_many_capitals, "D": holds_symbols}
COPY_FILTER = "E"

Condition = Callable[[bytes, list[bytes]], bool]


def judged(docs: DataFrame, part: str = "lang", filters: dict[str, Condition] | None = None) -> DataFrame:
    """``doc_id, part, mask, digest`` of every document; bit k of the mask is set where the k-th condition holds."""
    conditions = list((TEXT_FILTERS if filters is None else filters).values())

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests = [], []
            for value in batch.column("text").cast(pa.large_binary()):
                raw = value.as_py() or b""
                # On bytes, split() ends words at exactly the six ASCII white space characters.
                words = raw.split()
                found.append(sum(1 << k for k, fails in enumerate(conditions) if fails(raw, words)))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("part"), pa.array(found, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "mask", "digest"],
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("part", T.StringType()),
            T.StructField("mask", T.IntegerType()),
            T.StructField("digest", T.BinaryType()),
        ]
    )
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(tidy(masks), schema)


def with_copies(rows: DataFrame, bit: int, steps: Steps) -> DataFrame:
    """``rows`` with ``bit`` of the mask set where a smaller id has the same text."""
    # Stored, so the join can split a hot text: its other side has one row per text that occurs again.
    firsts = steps.table(
        rows.where("doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("digest", "first"),
        "firsts",
    )
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    mask = F.col("mask").bitwiseOR(F.when(copy, 1 << bit).otherwise(0))
    return rows.join(firsts, "digest", "left").withColumn("mask", mask).drop("first")


def with_labels(rows: DataFrame, labels: DataFrame, steps: Steps) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, 0 or 1; documents without a label have 0."""
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    known = steps.table(
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(*(F.max(F.coalesce(is_so, F.lit(False)).cast("int")).alias(name) for name, is_so in flags.items())),
        "labels",
    )
    found = rows.join(known, "doc_id", "left")
    return found.withColumns({name: F.coalesce(name, F.lit(0)) for name in flags})


def cells(rows: DataFrame) -> DataFrame:
    """One row per part and mask: documents, good ones and toxic ones."""
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("docs"), F.sum("good").cast("bigint").alias("good"), F.sum("toxic").cast("bigint").alias("toxic")
    )


def survivors(masks: np.ndarray, sizes: np.ndarray, filters: int) -> np.ndarray:
    """Row s: what is left of ``sizes`` (a row per cell) when the filters in the bits of s are active."""
    states = np.zeros((1 << filters, sizes.shape[1]), np.int64)
    failed = np.zeros(len(masks), np.int64)
    running = sizes.sum(axis=0)
    states[0] = running
    subset = 0
    for step in range(1, 1 << filters):
        bit = (step & -step).bit_length() - 1
        subset ^= 1 << bit
        touched = (masks >> bit & 1).astype(bool)
        if subset >> bit & 1:
            running = running - sizes[touched & (failed == 0)].sum(axis=0)
            failed[touched] += 1
        else:
            failed[touched] -= 1
            running = running + sizes[touched & (failed == 0)].sum(axis=0)
        states[subset] = running
    return states


def interactions(states: np.ndarray, names: Sequence[str]) -> Iterator[tuple]:
    """Order, step and counts of every order of the filters, as differences of the states."""
    count = len(names)
    every = (1 << count) - 1
    lost = lambda before, bit: states[before] - states[before | 1 << bit]
    failing = [int(lost(0, k)[0]) for k in range(count)]
    unique = [int(lost(every & ~(1 << k), k)[0]) for k in range(count)]
    shapley = [0] * count
    for k in range(count):
        for before in range(1 << count):
            if not before >> k & 1:
                size = before.bit_count()
                shapley[k] += math.factorial(size) * math.factorial(count - 1 - size) * int(lost(before, k)[0])
    for order in itertools.permutations(range(count)):
        before = 0
        for step, k in enumerate(order, 1):
            removed, good, toxic = (int(v) for v in lost(before, k))
            before |= 1 << k
            yield (
                "".join(names[i] for i in order),
                step,
                int(states[before][0]),
                removed,
                failing[k] - removed,
                unique[k],
                good,
                toxic,
                shapley[k],
            )


REPORT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def orders(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """The report on ``cells``; a task sees the cells of one part, of which there are 2^f at most."""

    def report(group: pa.Table) -> pa.Table:
        masks = group["mask"].to_numpy()
        sizes = np.stack([group[c].to_numpy() for c in ("docs", "good", "toxic")], axis=1)
        part = group["part"][0].as_py()
        rows = [(part, *row) for row in interactions(survivors(masks, sizes, len(names)), names)]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.table(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
            names=[field.split(" ")[0] for field in REPORT.split(", ")],
        )

    return counted.groupBy("part").applyInArrow(report, REPORT)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Counts of every order and step of the five filters, per part."""
    steps = Steps(docs.sparkSession, "filter-audit")
    rows = steps.table(judged(docs, part), "judged")
    rows = with_copies(rows, len(TEXT_FILTERS), steps).drop("digest")
    return orders(cells(with_labels(rows, labels, steps)), [*TEXT_FILTERS, COPY_FILTER])


SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), counted AS (
    SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           min(doc_id) OVER (PARTITION BY text) AS first
    FROM texts
), failed AS (
    SELECT doc_id, part,
           (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
           || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
           || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
           || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
           || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
    FROM counted
), flags AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), cells AS (
    SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM failed LEFT JOIN flags USING (doc_id) GROUP BY part, fails
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
    JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
    SELECT filter_order, s AS step, substr(filter_order, s, 1) AS x, substr(filter_order, 1, s - 1) AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), judged AS (
    SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS hit, translate(fails, before, '') = fails AS there,
           fails = x AS alone
    FROM cells, steps
), counts AS (
    SELECT part, filter_order, step, x,
           sum(CASE WHEN there AND NOT hit THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN there AND hit THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN hit AND NOT there THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN there AND hit THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN there AND hit THEN toxic ELSE 0 END) AS toxic_lost
    FROM judged GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counts
"""
