"""The filter audit against filters that are run in every order."""

from __future__ import annotations

import collections
import itertools
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from compare import compare, connect

sys.path.insert(0, str(Path(__file__).resolve().parent))

import data  # noqa: E402

from cohortspan.llm import filter_audit  # noqa: E402
from cohortspan.llm import queries as Q  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text, doc_id, ids_of):
    words = WORD.findall(text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": doc_id is not None and any(i is not None and i < doc_id for i in ids_of[text]),
    }


def audited(rows, labels):
    """Every order run filter by filter: rows are (doc_id, text, part), labels (doc_id, quality, toxic)."""
    ids_of = collections.defaultdict(list)
    for doc_id, text, _ in rows:
        ids_of[text or ""].append(doc_id)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts = collections.defaultdict(list)
    for doc_id, text, part in rows:
        parts[part or ""].append((doc_id, fails(text or "", doc_id, ids_of)))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left, gone = docs, []
            for step, name in enumerate(order, 1):
                removed = [d for d in left if d[1][name]]
                shapley[name] += len(removed)
                left = [d for d in left if not d[1][name]]
                only = sum(f[name] and sum(f.values()) == 1 for _, f in docs)
                redundant = sum(f[name] for _, f in gone)
                gone = gone + removed
                out[part, "".join(order), step] = (
                    len(left),
                    len(removed),
                    redundant,
                    only,
                    sum(i in good for i, _ in removed),
                    sum(i in toxic for i, _ in removed),
                )
        for key in [k for k in out if k[0] == part]:
            out[key] += (shapley[key[1][key[2] - 1]],)
    return out


def found(spark, rows, labels, extra=False):
    full = [(i, t, p, "s", None) for i, t, p in rows]
    docs = spark.createDataFrame(full, data.DOCUMENTS)
    if extra:
        docs = docs.selectExpr("*", *(f"'own' AS {c}" for c in "part mask digest first last good toxic docs".split()))
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    if extra:
        known = known.selectExpr("*", "'own' AS good", "'own' AS part", "'own' AS mask")
    report = filter_audit.audit(docs, known).collect()
    assert len({(r.part, r.filter_order, r.step) for r in report}) == len(report)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in report}


def texts(rng):
    return [
        None,
        "",
        " ".join(data.sentence(rng, 300).split()),
        "ab " * 250,
        "AB " * 250,
        "one two #three",
        data.sentence(rng, 199) + " last",
        data.sentence(rng, 198) + " last",
        "\x1c\x85  no space between ends a word",
        "x y " * 100,
        "X" * 3 + "y" * 97,
        "X" * 4 + "é" * 96,
        "|" + data.sentence(rng, 250),
    ]


def test_every_order_matches_filters_run_one_by_one(spark):
    rng = random.Random(3)
    pool = texts(rng)
    rows = [(rng.choice([None, *range(60)]), rng.choice(pool), rng.choice(["en", "de", "", None])) for _ in range(90)]
    rows += [(100, data.sentence(rng, 260), "only one")]
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    wanted = audited(rows, labels)
    assert found(spark, rows, labels) == wanted
    assert found(spark, rows, labels, extra=True) == wanted
    assert any(v[2] for v in wanted.values()) and any(v[4] for v in wanted.values()) and any(v[5] for v in wanted.values())


def test_query_equals_sql(spark):
    name = "op11_filter_interaction_audit"
    assert compare(spark, connect(SMALL), Q.queries()[name], Q.oracle_sql()[name], SMALL) == ""


def test_empty_tables_and_missing_labels(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, None, None)], []) == audited([(1, None, None)], [])


def test_a_very_long_text_and_many_copies(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(k, long if k % 2 else "same words", "en") for k in range(20)]
    assert found(spark, rows, [(3, 1, 1)]) == audited(rows, [(3, 1, 1)])


@pytest.mark.parametrize("filters", [0, 1, 3, 6])
def test_states_of_any_number_of_filters(filters):
    rng = np.random.default_rng(filters)
    masks = rng.integers(0, 1 << filters, 25)
    sizes = rng.integers(0, 50, (25, 3))
    states = filter_audit.survivors(masks, sizes, filters)
    for active in range(1 << filters):
        assert (states[active] == sizes[masks & active == 0].sum(axis=0)).all()


def test_report_names_every_order_of_other_filters(spark):
    conditions = {"x": lambda raw, words: len(words) > 2, "y": lambda raw, words: b"q" in raw}
    docs = spark.createDataFrame([(1, "a b c", "p", "", 0), (2, "q", "p", "", 0), (3, "q r s", "p", "", 0)], data.DOCUMENTS)
    rows = filter_audit.judged(docs, "lang", conditions).selectExpr("*", "0 AS good", "0 AS toxic")
    report = filter_audit.orders(filter_audit.cells(rows), "xy").collect()
    assert {(r.filter_order, r.step, r.kept, r.removed, r.redundant) for r in report} == {
        ("xy", 1, 1, 2, 0),
        ("xy", 2, 0, 1, 1),
        ("yx", 1, 1, 2, 0),
        ("yx", 2, 0, 1, 1),
    }
