"""Document fingerprints (I-Match): hashes of the distinct terms in a band of document frequency.

Terms are the lower-case runs of letters and digits. The lexicon keeps those whose share of documents lies in
a band, which leaves out words too common to tell texts apart and words too rare to survive an edit. Each of
``SUBSETS`` parts of the lexicon, the whole and random ones from an eighth down to one in 1024, gives one hash: of
the set of a text's terms in it. Large parts agree only for near copies, small ones also for texts that share a
portion.

The hash of a set is a hash of the sum of its distinct terms' hashes. It stands for hashing the sorted terms, one
value per set, and can be added up row by row: no task gathers or sorts the terms of a text.

The lexicon is bounded: a term in at least the fraction f of N documents takes f N of the at most N m pairs of
document and term (m: mean distinct terms), so there are at most m / f of them, whatever N is. It is sent by
broadcast while its stored size is below ``BROADCAST_BYTES`` and joined by a shuffle beyond it. Terms are exploded
and summed up again inside the partition of their document, so a text is shuffled once.

Everything is DataFrame functions; there is no Python in any plan.

Edge cases: null counts as empty. A text without a term in the lexicon has the hash of its whole text as
fingerprint. Equal texts have equal fingerprints and likeness 1. Repeated rows (same id and text) share one
place in the order of documents; documents without an id come first; of two texts with one id the one with the
smaller hash comes first. A table of one document has that document as its next. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import Steps, numbered

SUBSETS = 32
DIGITS = 4
# Share of all documents that a term of the lexicon occurs in.
LOW, HIGH = 0.0005, 0.2
BROADCAST_BYTES = 24 << 20
# What names a document, see keyed_texts.
KEY = ["i", "z", "h"]
TERM_BREAK = r"[^\p{L}\p{N}]+"


def terms(text: str) -> Column:
    """Distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.col(text)), TERM_BREAK)), "")


def lexicon(texts: DataFrame, steps: Steps, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``term, hash`` (40 bits) and ``parts`` (a bit per subset that holds the term) for the terms in the band.

    Subset 0 keeps every term, subset k > 0 a term with chance 2^-(3 + k mod 8).
    """
    total = texts.count()
    counted = texts.select(F.explode(terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    kept = counted.where((F.col("n") >= low * total) & (F.col("n") <= max(high * total, 1.0)))
    bits = F.lit(0).cast("bigint")
    for k in range(SUBSETS):
        draw = F.xxhash64(F.lit(k), "term").bitwiseAND(F.lit((1 << (3 + k % 8 if k else 0)) - 1)) == 0
        bits = bits.bitwiseOR(F.when(draw, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    kept = kept.select("term", F.xxhash64("term").bitwiseAND(F.lit((1 << 40) - 1)).alias("hash"), bits.alias("parts"))
    words, path = steps.store(kept, "lexicon")
    return F.broadcast(words) if steps.size(path) <= BROADCAST_BYTES else words


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``i, z, h, text``: id (0 for null), whether it is null, hash of the text, and the text (empty for null).

    The three name a document by plain equality, so all steps on them use one partitioning.
    """
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.select(
        F.coalesce("doc_id", zero).alias("i"), F.col("doc_id").isNull().alias("z"), F.xxhash64("text").alias("h"), "text"
    )


def following(keyed: DataFrame, steps: Steps) -> DataFrame:
    """``i, z, h, n`` (code points) of every distinct document, how often it comes, and its next one's name."""
    known = keyed.groupBy(*KEY).agg(F.first(F.char_length("text")).alias("n"), F.count("*").alias("rows"))
    places, _ = steps.store(numbered(known, [F.desc("z"), "i", "h"], steps, "place"), "places")
    total = max(places.count(), 1)
    after = places.select(F.col("place").alias("next"), *(F.col(c).alias(f"next_{c}") for c in KEY))
    return steps.table(places.withColumn("next", (F.col("place") + 1) % total).join(after, "next").drop("next", "place"), "pairs")


def with_edited(keyed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``i, z, h, text, edited``: the last half of each text replaced by the beginning of the next document.

    The texts are shuffled once: both joins want them by the same key.
    """
    wanted = pairs.select(*(F.col(c).alias(f"for_{c}") for c in KEY), *(F.col(f"next_{c}").alias(c) for c in KEY), "n")
    heads = keyed.join(wanted, KEY).select(
        *(F.col(f"for_{c}").alias(c) for c in KEY),
        F.floor(F.col("n") / 2).cast("int").alias("half"),
        F.expr("substring(text, 1, CAST(floor(n / 2) AS INT))").alias("head"),
    )
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - half)"), "head")
    return keyed.join(heads, KEY).select(*KEY, "text", edited.alias("edited"))


def set_hashes(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Per document both fingerprints and the digest of the edited text."""

    def listed(column: str, edited: int) -> Column:
        plain = F.transform(
            terms(column),
            lambda t: F.struct(t.alias("term"), F.lit(edited).alias("edited"), F.lit(None).cast("string").alias("digest")),
        )
        whole = F.struct(
            F.lit("").alias("term"),
            F.lit(edited).alias("edited"),
            F.sha2(F.col(column).cast("binary"), 256).alias("digest"),
        )
        return F.concat(F.array(whole), plain)

    rows = texts.select(*KEY, F.explode(F.concat(listed("text", 0), listed("edited", 1))).alias("x"))
    found = rows.select(*KEY, "x.*").join(words, "term", "left")
    sums = [
        F.sum(F.when(F.col("parts").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, F.col("hash"))).alias(f"s{k}")
        for k in range(SUBSETS)
    ]
    each = found.groupBy(*KEY, "edited").agg(F.count("hash").alias("n"), F.max("digest").alias("digest"), *sums)
    printed = each.select(*KEY, "edited", "digest", shown().alias("print"))
    return printed.groupBy(*KEY).agg(
        F.max(F.when(F.col("edited") == 0, F.col("print"))).alias("fingerprint"),
        F.max(F.when(F.col("edited") == 1, F.col("print"))).alias("edited_fingerprint"),
        F.max(F.when(F.col("edited") == 1, F.col("digest"))).alias("edited_sha256"),
    )


def shown() -> Column:
    """A fingerprint as text: ``DIGITS`` hexadecimal digits per subset, dots for a subset without terms."""
    parts = [
        F.when(F.col(f"s{k}").isNull(), "." * DIGITS).otherwise(
            F.lpad(F.lower(F.hex(F.xxhash64(f"s{k}").bitwiseAND(F.lit((1 << (4 * DIGITS)) - 1)))), DIGITS, "0")
        )
        for k in range(SUBSETS)
    ]
    return F.when(F.col("n") > 0, F.concat(*parts)).otherwise(F.concat(F.lit("text:"), "digest"))


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the subsets in which either fingerprint has terms; 1 for equal ones."""
    empty = "." * DIGITS

    def part(name: str, k: int) -> Column:
        return F.substring(F.col(name), DIGITS * k + 1, DIGITS)

    equal = either = F.lit(0)
    for k in range(SUBSETS):
        equal = equal + F.when((part(a, k) == part(b, k)) & (part(a, k) != empty), 1).otherwise(0)
        either = either + F.when((part(a, k) != empty) | (part(b, k) != empty), 1).otherwise(0)
    plain = F.col(a).startswith("text:") | F.col(b).startswith("text:")
    return F.when(F.col(a) == F.col(b), 1.0).when(plain | (either == 0), 0.0).otherwise(equal / either)


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and how alike it is to that and to the next document."""
    steps = Steps(docs.sparkSession, "imatch")
    keyed = keyed_texts(docs)
    words = lexicon(keyed, steps, low, high)
    pairs = following(keyed, steps)
    once = keyed if pairs.where("rows > 1").isEmpty() else keyed.dropDuplicates(KEY)
    prints, _ = steps.store(set_hashes(with_edited(once, pairs), words), "prints")
    theirs = prints.select(*(F.col(c).alias(f"next_{c}") for c in KEY), F.col("fingerprint").alias("next_fingerprint"))
    rows = pairs.join(prints, KEY).join(theirs, [f"next_{c}" for c in KEY])
    return rows.select(
        F.when(~F.col("z"), F.col("i")).alias("doc_id"),
        F.col("n").cast("bigint").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
        F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("row"),
    ).drop("row")
