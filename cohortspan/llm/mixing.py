"""Mixing sources to target weights by systematic sampling.

The size of a document is its number of words. Sources in code point order, null last, get the weights
in turn and share all words by them; a source's target stops at ``LIMIT`` times its own words and what
is over goes to the others by weight, until no source is above. All documents of a source then expect
the same number of copies, target by words. Their prefix sum runs over the source in order of size, is
moved by one offset per source, and a document is taken once per whole number it crosses. Size order
makes the sample even over short and long documents, so the words taken come near the target.

The order is total and the offset is a hash of the source's name and a seed: reruns agree. The place in
the order comes from one range sort over all sources, so a source of any size spreads over many tasks.

Edge cases: a null or empty text has size 0; a source without words has target 0 and is not taken; null is
a source of its own, different from the empty name; repeated rows are separate documents; rows without an
id sort first. An empty table gives an empty mix. Columns of any name are carried through unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import Steps, numbered

WEIGHTS = (5, 2, 1)
# Most copies of a document, on average over its source and for each document.
LIMIT = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def offset(source: str = "source", seed: int = 0) -> Column:
    """A number in [0, 1) with 24 bits for each source."""
    name = F.coalesce(F.concat(F.lit(f"{seed}:s:"), F.col(source)), F.lit(f"{seed}:n"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))


def targets(sources: DataFrame, steps: Steps, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``source, words`` with ``target``: all words shared by weight, none above ``limit`` times its words."""
    table, _ = steps.store(
        numbered(sources, [F.col("source").asc_nulls_last()], steps, "place").withColumn(
            "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
        ),
        "sources",
    )
    total = table.agg(F.sum("words")).first()[0] or 0
    level, full = 0.0, -1
    while total:
        over = F.lit(level) * F.col("weight") > limit * F.col("words")
        now = table.agg(
            F.count_if(over).alias("full"),
            F.sum(F.when(over, limit * F.col("words")).otherwise(0)).alias("held"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if now["full"] == full:
            break
        full, level = now["full"], (total - now["held"]) / now["weight"]
    share = F.lit(level) * F.col("weight")
    most = (limit * F.col("words")).cast("double")
    return table.withColumn("target", F.when(share > most, most).otherwise(share)).select("source", "words", "target")


def mixed(
    docs: DataFrame,
    carry: list[Column],
    weights: tuple[int, ...] = WEIGHTS,
    limit: int = LIMIT,
    seed: int = 0,
) -> DataFrame:
    """Every document with size, source, source_size, target, copies and the carried columns."""
    steps = Steps(docs.sparkSession, "mixing")
    rows = docs.select("doc_id", "source", word_count().alias("size"), *carry)
    rows = numbered(rows, [F.col("source").asc_nulls_last(), "size", "doc_id"], steps, "place")
    sources = rows.groupBy("source").agg(F.sum("size").alias("words"), F.min("place").alias("first"))
    sources, _ = steps.store(sources, "sizes")
    goal = targets(sources.select("source", "words"), steps, weights, limit)
    per_source = (
        sources.alias("s")
        .join(goal.select(F.col("source").alias("name"), "target"), F.col("s.source").eqNullSafe(F.col("name")))
        .select(
            F.col("s.source").alias("name"),
            "first",
            F.col("words").alias("source_size"),
            "target",
            F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0)).alias("expected"),
            offset("s.source", seed).alias("offset"),
        )
    )
    # Stored, so that Spark knows its size before it plans the join: the documents then move only where it is large.
    per_source = steps.table(per_source, "per-source")
    at = F.col("place") - F.col("first")
    crossed = F.floor(F.col("expected") * (at + 1) + F.col("offset")) - F.floor(F.col("expected") * at + F.col("offset"))
    return rows.join(per_source, F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "copies", F.least(crossed, F.lit(limit)).cast("bigint")
    )


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 0) -> DataFrame:
    """Per document: size, source_size, target and the words that the mix takes from it."""
    return mixed(docs, [], weights, limit, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 0) -> DataFrame:
    """The mixed documents themselves, columns as they were, each as often as it is taken."""
    rows = mixed(docs, [F.struct(*docs.columns).alias("row")], weights, limit, seed)
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


# The levels at which sources fill up, in order of how soon they do, give the share of the others.
SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM sources
), filling AS (
  SELECT *, CAST(3 * words AS DOUBLE) / weight AS full_at FROM weighted
), levels AS (
  SELECT full_at, CAST(sum(words) OVER () - coalesce(sum(3 * words) OVER before, 0) AS BIGINT)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level,
    row_number() OVER (ORDER BY full_at, source) AS nth
  FROM filling WINDOW before AS (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
  SELECT level FROM levels WHERE level <= full_at ORDER BY nth LIMIT 1
), goals AS (
  SELECT source, words, CASE WHEN words = 0 THEN CAST(0 AS DOUBLE) ELSE least(level * weight, CAST(3 * words AS DOUBLE)) END AS target
  FROM weighted, settled
), placed AS (
  SELECT s.doc_id, s.source, s.size, g.words AS source_size, g.target,
    CASE WHEN g.words > 0 THEN g.target / g.words ELSE CAST(0 AS DOUBLE) END AS expected,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) AS nth,
    CAST(CAST('0x' || substr(md5(coalesce('0:s:' || s.source, '0:n')), 1, 6) AS BIGINT) AS DOUBLE) / 16777216 AS moved
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), taken AS (
  SELECT *, CAST(floor(expected * nth + moved) - floor(expected * (nth - 1) + moved) AS BIGINT) AS copies FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM taken
"""
