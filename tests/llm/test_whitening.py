"""Whitening against the same moments computed in plain numpy and Python integers."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspan.llm import queries as Q
from cohortspan.llm import whitening

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int"


def takes_part(vector):
    return bool(vector) and all(c is not None and math.isfinite(c) for c in vector)


def wanted(rows, components=8, by_copies=True, scale=1024, shift=100_000):
    """id -> component -> (n, deviation, whitened, explained), signs with the largest axis entry positive."""
    there = [(i, tuple(math.floor(scale * float(np.float32(c))) + shift for c in v)) for i, v in rows if takes_part(v)]
    fitted = [x for _, x in there] if by_copies else list({x for _, x in there})
    n, dim = len(fitted), len(fitted[0])
    sums = [sum(x[k] for x in fitted) for k in range(dim)]
    mean = np.array(sums) / n
    off = np.array(fitted, float) - mean
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = collections.defaultdict(list)
    for i, x in there:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k in range(min(components, dim)):
            axis = axes[:, k] * np.sign(axes[np.abs(axes[:, k]).argmax(), k])
            white = (np.array(x) - mean) @ axis / np.sqrt(values[k]) if values[k] > 1e-9 else None
            out[i].append((k + 1, n, deviation, white, values[k] / values.sum() if values.sum() else 0.0))
    return out


def check(report, rows, tolerance=1e-6, **options):
    expected = wanted(rows, **options)
    got = collections.defaultdict(list)
    for r in report:
        got[r.vec_id].append((r.component, r.n, int(r.deviation), r.whitened, r.explained))
        assert r.identity_error is None or r.identity_error < 1e-6
    assert got.keys() == expected.keys()
    for i, lines in expected.items():
        for a, b in zip(sorted(got[i], key=lambda v: v[:3]), sorted(lines, key=lambda v: v[:3]), strict=True):
            assert a[:3] == b[:3]
            assert a[4] == pytest.approx(b[4], rel=1e-6, abs=1e-9)
            assert (a[3] is None) == (b[3] is None)
            assert a[3] is None or a[3] == pytest.approx(b[3], rel=tolerance, abs=tolerance)


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    if extra:
        df = df.select("*", *(F.lit(f"own {c}").alias(c) for c in "id dim packed copies n component at line scores".split()))
    return df


def stored(spark, folder=SMALL):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]


def cloud(seed, count, dim=12):
    """Vectors with distinct variances, some of them copied often."""
    rng = np.random.default_rng(seed)
    base = (rng.normal(size=(count, dim)) * np.linspace(3, 0.3, dim) + 5).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(base)]
    return rows + [(count + k, base[0]) for k in range(count)] + [(2 * count + k, base[k % 3]) for k in range(7)]


def test_query_on_the_given_table(spark):
    rows = stored(spark)
    report = Q.queries()["op13_embedding_whitening"](spark, SMALL)
    assert dict(report.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    check(report.collect(), rows)


@pytest.mark.parametrize("by_copies", [True, False])
def test_copies_weigh_as_asked(spark, by_copies):
    rows = cloud(1, 200)
    report = whitening.whiten(frame(spark, rows, extra=True), by_copies=by_copies).collect()
    check(report, rows, by_copies=by_copies)
    scores = collections.defaultdict(set)
    for r in report:
        scores[r.component].add((r.vec_id, r.whitened))
    assert all(len(s) == len(rows) for s in scores.values())


def test_rows_that_take_no_part(spark):
    rows = cloud(2, 40) + [
        (900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [1.0] * 11 + [float("nan")]),
        (904, [float("inf")] + [0.0] * 11), (905, [-0.0] * 12), (906, [1e-30] * 12), (None, [0.5] * 12),
    ]
    report = whitening.whiten(frame(spark, rows)).collect()
    check(report, rows)
    assert {r.vec_id for r in report} >= {905, 906, None} and not {900, 901, 902, 903, 904} & {r.vec_id for r in report}


def test_shorter_vectors_take_no_part(spark):
    rows = cloud(3, 30)
    report = whitening.whiten(frame(spark, rows + [(901, [1.0, 2.0])])).collect()
    check(report, rows)


def test_repeated_rows_are_rows(spark):
    rows = cloud(4, 30)
    check(whitening.whiten(frame(spark, rows * 2)).collect(), rows * 2)


def test_empty_table_and_table_of_nulls(spark):
    for rows in ([], [(1, None), (2, [])]):
        report = whitening.whiten(frame(spark, rows))
        assert report.collect() == [] and report.columns[:3] == ["vec_id", "component", "n"]


def test_without_variance(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])]
    report = whitening.whiten(frame(spark, rows)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in report] == [(0, None, 0.0, None)] * 6
    line = [(k, [float(k), 2.0 * k, 1.0]) for k in range(5)]
    report = whitening.whiten(frame(spark, line)).collect()
    assert {r.component: r.whitened is None for r in report} == {1: False, 2: True, 3: True}
    assert all(r.identity_error < 1e-9 for r in report)


def test_large_entries_stay_exact(spark):
    rng = random.Random(5)
    rows = [(k, [float(rng.randrange(1 << 24)) * 2**21, float(rng.randrange(1 << 24)) * 2**18]) for k in range(50)]
    report = whitening.whiten(frame(spark, rows)).collect()
    assert all(r.deviation.bit_length() <= 126 if isinstance(r.deviation, int) else True for r in report)
    check(report, rows)


def test_entries_beyond_62_bits_are_an_error(spark):
    with pytest.raises(Exception, match="62 bits"):
        whitening.whiten(frame(spark, [(1, [1e30, 1.0]), (2, [1.0, 1.0])])).collect()


def test_packed_vectors_come_back_and_equal_ones_pack_alike():
    rows = np.array([[1, -5, 32767], [1, 40_000, 2], [1 << 40, 0, -3], [1, -5, 32767], [-32768, 0, 0], [-32769, 0, 0]])
    packed = whitening.pack(rows)
    assert (whitening.unpack(packed, 3) == rows).all()
    assert packed[0] == packed[3] and len(packed[4].as_py()) == 7 and len(packed[5].as_py()) == 13
