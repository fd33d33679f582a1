"""Small documents with every awkward case."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Names that operators use for columns of their own.
CLASHING = "h core span first last at row place size copies target label rep score key part next n offset".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def passages(seed=1, count=40):
    """Texts that share whole texts, passages, and near copies; ids are distinct."""
    rng = random.Random(seed)
    shared = [sentence(rng, n) for n in (49, 50, 51, 90, 160)]
    base = [sentence(rng, 220) for _ in range(4)]
    rows = []
    for k in range(count):
        kind = k % 8
        if kind == 0:
            text = rng.choice(base)
        elif kind in (1, 2):
            parts = rng.choice(base).split(" ")
            for _ in range(rng.choice((1, 3, 9))):
                parts[rng.randrange(len(parts))] = sentence(rng, 1)
            text = " ".join(parts)
        elif kind in (3, 4):
            text = sentence(rng, rng.randint(0, 60)) + " " + rng.choice(shared) + "\n" + sentence(rng, rng.randint(0, 60))
        elif kind == 5:
            text = rng.choice(shared) + " " + rng.choice(shared) + "\t" + rng.choice(shared)
        elif kind == 6:
            text = sentence(rng, rng.randint(1, 120))
        else:
            text = ("ab " * rng.randint(1, 300)) if rng.random() < 0.5 else "x" * rng.randint(1, 900)
        rows.append((k * 3, text))
    rng.shuffle(rows)
    return rows


def awkward():
    """Nulls, empty and long texts, white space only, repeated rows, other scripts."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, long),
        (5, long),
        (5, long),
        (6, "one two three"),
        (7, "one two three"),
        (8, "日本語 テキスト ǅ İstanbul ΣΑΣ é it's 123 !!! <|endoftext|>x y \x1c z"),
        (9, "  double  spaces \n\n and lines\r\n"),
        (None, "one two three"),
        (None, None),
    ]


def documents(spark, rows, extra=False):
    full = [(i, t, "en", ("a", "b", None)[k % 3], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, DOCUMENTS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    return df
