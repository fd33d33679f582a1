"""Submissions arriving as JSON files, ingested micro-batch by micro-batch with keyed state.

Two operators with state decide about every submission. The first keeps a bit per submission id: whatever comes again, in
the same batch or in a later one, gets no second decision. The second keeps the known users and the days that they have a
visit on. Known users and stored visits are its initial state, read once when the stream starts; users who register later
come through a stream of their own. The highest visit id lives in a small row per batch. So no batch reads a table that
grows, and a batch costs what it brings.

Every call on the state is a message between worker and executor, which costs more than the rest of a submission. So the
keys are blocks of neighbouring ids, with one value each: a block is read once and written once in a batch, however many
of its ids the batch brings. A value holds 128 bytes, or the days of 16 users.

State is kept in RocksDB with its checkpoints in the checkpoint folder. A batch that is replayed finds the state as it
was before the batch and writes the same rows to the same folders.

``max_files`` bounds a batch, and with it what one very frequent user brings to a task at a time: the headers and values
of that user in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

import cohortspan
from cohortspan.functions.dates import iso_date
from cohortspan.functions.ordinals import numbered
from cohortspan.operators.ingest import (
    CONFLICTING,
    DUPLICATE_SESSION,
    INVALID_DATE,
    INVALID_VALUE,
    NULL_VALUE,
    REPEATED_BIOMARKER,
    UNKNOWN_BIOMARKER,
    UNKNOWN_USER,
    visit_time,
)
from cohortspan.session import cut_lineage

# Send the processors below to the workers by value, so they need not have this package installed.
cloudpickle.register_pickle_by_value(cohortspan)

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_VALUES = T.ArrayType(
    T.StructType([T.StructField("biomarkerId", T.IntegerType()), T.StructField("value", T.DecimalType(12, 4))])
)
# One record per submission, as the service takes it.
SUBMISSION_JSON = T.StructType(
    [
        T.StructField("SubmissionID", T.LongType()),
        T.StructField("UserID", T.IntegerType()),
        T.StructField("sessionDate", T.StringType()),
        T.StructField("fastingStatus", T.BooleanType()),
        T.StructField("measurements", _VALUES),
    ]
)

# Rows that need no state are dealt over so many keys, in slots from 0; rows that do have the slot -1.
_SLOTS = 4096
_STATEFUL = -1
# So many low bits of an id are its place in a block, which is the key of its state.
_SUBMISSION_BITS, _USER_BITS = 10, 4
_USER, _SUBMISSION = "user", "submission"


class FirstDelivery(StatefulProcessor):
    """Per submission: its body when it first arrives, and whether several different bodies arrived at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.decided = handle.getValueState("decided", "ids binary")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        if key[1] != _STATEFUL:  # no id, nothing to remember: every delivery is a submission
            for row in rows:
                yield Row(Body=row["Body"], Conflict=False)
            return
        first: dict[int, tuple[str, bool]] = {}
        for row in rows:
            place, body = row["Place"], row["Body"]
            least, conflict = first.get(place, (body, False))
            first[place] = min(least, body), conflict or body != least
        stored = self.decided.get()
        before = int.from_bytes(stored[0], "little") if stored else 0
        after = before
        for place, (body, conflict) in first.items():
            if not before >> place & 1:
                after |= 1 << place
                yield Row(Body=body, Conflict=conflict)
        if after != before:
            self.decided.update((after.to_bytes(-(-after.bit_length() // 8), "little"),))

    def close(self) -> None:
        pass


class VisitsOfUser(StatefulProcessor):
    """Per user: one visit a day, the acceptable submission of the lowest number in the first batch that has one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Places of the known users, and their days: each with the place of its user in the low bits.
        self.visited = handle.getValueState("visited", "users array<int>, visits array<bigint>")

    def handleInitialState(self, key, state, timer_values) -> None:
        for row in state if not isinstance(state, Row) else [state]:  # one row per block
            self.visited.update((list(row["Users"]), list(row["Visits"])))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        if key[1] != _STATEFUL:  # a slot of submissions that are decided already
            for row in rows:
                yield Row(Body=row["Body"], Reason=row["Own"])
            return
        found, winners = [], {}
        registered = set()
        for row in rows:
            user = row["Place"]
            if row["Kind"] == _USER:
                registered.add(user)
                continue
            visit, number, own = row["Day"] << _USER_BITS | user, row["SubmissionID"], row["Own"]
            found.append((user, visit, number, own, row["Body"]))
            if own is None:
                winners[visit] = min(winners.get(visit, number), number)
        users, taken = map(set, self.visited.get() or ([], []))
        known = users | registered
        for user, visit, number, own, body in found:
            if user not in known:
                yield Row(Body=body, Reason=UNKNOWN_USER)
                continue
            late = visit in taken or visit in winners and winners[visit] < number
            yield Row(Body=body, Reason=DUPLICATE_SESSION if late else own)
        added = {visit for user, visit, _, own, _ in found if own is None and user in known} - taken
        if added or known != users:
            self.visited.update((sorted(known), sorted(taken | added)))

    def close(self) -> None:
        pass


def slot(stateful: Column, spread: Column) -> Column:
    return F.when(stateful, _STATEFUL).otherwise(F.pmod(F.xxhash64(spread), F.lit(_SLOTS)).cast("int"))


def block(number: Column, bits: int) -> tuple[Column, Column]:
    """The block of a number and its place in the block."""
    return F.shiftright(number, bits), number.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def first_deliveries(bodies: DataFrame) -> DataFrame:
    """``Body, Conflict`` of every submission that has not been decided before."""
    values = F.array_sort("measurements")  # the order of the values is no difference
    body = F.to_json(F.struct("SubmissionID", "UserID", "sessionDate", "fastingStatus", values.alias("measurements")))
    own, place = block(F.coalesce("SubmissionID", F.lit(0)), _SUBMISSION_BITS)
    rows = bodies.select("SubmissionID", body.alias("Body")).select(
        own.alias("Block"),
        slot(F.col("SubmissionID").isNotNull(), F.col("Body")).alias("Slot"),
        place.alias("Place"),
        "Body",
    )
    return rows.groupBy("Block", "Slot").transformWithState(
        FirstDelivery(), "Body string, Conflict boolean", "Append", "None"
    )


def own_reason(biomarkers: list[int]) -> tuple[Column, Column]:
    """What is wrong with a submission whoever sent it, and what is wrong with its values, from ``b``, its body."""
    date = F.when(F.col("b.measurements").isNotNull(), F.col("b.sessionDate"))
    incomplete = (
        F.coalesce(date, F.lit("")).eqNullSafe("") | F.col("b.fastingStatus").isNull() | F.col("b.SubmissionID").isNull()
    )
    early = (
        F.when(F.col("Conflict"), CONFLICTING)
        .when(incomplete, INVALID_VALUE)
        .when(iso_date(date).isNull(), INVALID_DATE)
        .when(F.col("b.UserID").isNull(), UNKNOWN_USER)
    )
    ids = F.transform("b.measurements", lambda m: m["biomarkerId"])
    known = F.array(*[F.lit(i) for i in biomarkers]).cast("array<int>")
    values = (
        F.when(F.exists(ids, lambda i: i.isNull() | ~F.array_contains(known, i)), UNKNOWN_BIOMARKER)
        .when(F.exists("b.measurements", lambda m: m["value"].isNull()), NULL_VALUE)
        .when(F.size(F.array_distinct(ids)) < F.size(ids), REPEATED_BIOMARKER)
    )
    return early, values


def decisions(
    bodies: DataFrame, users: DataFrame, sessions: DataFrame, biomarkers: list[int], registrations: DataFrame | None
) -> DataFrame:
    """``Body, Reason`` of every new submission; no reason means accepted."""
    first = first_deliveries(bodies).withColumn("b", F.from_json("Body", SUBMISSION_JSON))
    early, values = own_reason(biomarkers)
    day = F.unix_date(iso_date(F.col("b.sessionDate")))
    judged = first.select(
        "Body", "b.SubmissionID", "b.UserID", early.alias("Early"), values.alias("Values"), day.alias("Day")
    )
    needs_user = F.col("Early").isNull()
    own, place = block(F.when(needs_user, F.col("UserID")).otherwise(0), _USER_BITS)
    keyed = judged.select(
        own.alias("Block"),
        place.alias("Place"),
        slot(needs_user, F.col("Body")).alias("Slot"),
        F.lit(_SUBMISSION).alias("Kind"),
        F.coalesce("SubmissionID", F.lit(0)).alias("SubmissionID"),
        F.coalesce("Day", F.lit(0)).alias("Day"),
        F.coalesce("Early", "Values").alias("Own"),
        "Body",
    )
    if registrations is not None:
        own, place = block(F.col("UserID").cast("int"), _USER_BITS)
        joined = registrations.where("UserID IS NOT NULL").select(
            own.alias("Block"),
            place.alias("Place"),
            F.lit(_STATEFUL).alias("Slot"),
            F.lit(_USER).alias("Kind"),
            F.lit(0).cast("bigint").alias("SubmissionID"),
            F.lit(0).alias("Day"),
            F.lit(None).cast("string").alias("Own"),
            F.lit(None).cast("string").alias("Body"),
        )
        keyed = keyed.unionByName(joined)
    days = sessions.select("UserID", F.unix_date("SessionDate").cast("bigint").alias("Day"))
    known = users.select(F.col("UserID").cast("int").alias("UserID")).distinct().join(days, "UserID", "left")
    own, place = block(F.col("UserID"), _USER_BITS)
    visit = F.shiftleft("Day", _USER_BITS).bitwiseOR(place)
    state = known.groupBy(own.alias("Block"), F.lit(_STATEFUL).alias("Slot")).agg(
        F.collect_set(place).alias("Users"), F.collect_set(visit).alias("Visits")
    )
    return keyed.groupBy("Block", "Slot").transformWithState(
        VisitsOfUser(), "Body string, Reason string", "Append", "None", initialState=state.groupBy("Block", "Slot")
    )


def ingest_stream(
    spark: SparkSession,
    source: str,
    target: str,
    users: DataFrame,
    sessions: DataFrame,
    biomarkers: DataFrame,
    checkpoint: str,
    ingested_at: str = "2001-12-31 00:00:00",
    max_files: int | None = None,
    registrations: DataFrame | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Read nested JSON records, one per submission, until none is left.

    There is one decision per SubmissionID, however often and in whichever batches it is delivered. Deliveries in one
    batch that differ conflict; later ones are passed over. ``target`` receives ``sessions``, ``measurements`` and
    ``rejected``, each in one folder per batch. ``users`` and ``sessions`` are what is known when the stream first
    starts with ``checkpoint``; afterwards the state knows. ``registrations`` is a stream with the UserID of new users.
    ``max_files`` is the number of files per batch, ``partitions`` that of the state, which stays what it is at the first start. Catalogs are definitions and small: ``biomarkers`` is a list of ids.
    """
    ids = [r["BiomarkerID"] for r in biomarkers.select("BiomarkerID").distinct().collect()]
    stored_highest = sessions.agg(F.max("SessionID")).first()[0] or 0
    session_id = sessions.schema["SessionID"].dataType

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        decided = cut_lineage(batch.withColumn("b", F.from_json("Body", SUBMISSION_JSON)).drop("Body"), "decided")
        decided = decided.withColumn("SubmissionID", F.col("b.SubmissionID"))
        highest = stored_highest
        if batch_id:
            highest = own.read.schema("SessionID BIGINT").parquet(f"{target}/highest/batch={batch_id - 1}").first()[0]
        header = ["SubmissionID", F.col("b.UserID").alias("UserID")]
        accepted = numbered(decided.where("Reason IS NULL"), "SessionID", ["SubmissionID"], highest + 1)
        accepted = cut_lineage(accepted.withColumn("SessionID", F.col("SessionID").cast(session_id)), "accepted")
        date = iso_date(F.col("b.sessionDate")).alias("SessionDate")
        visits = accepted.select(
            "SubmissionID", "SessionID", F.col("b.UserID").alias("UserID"), date, F.col("b.fastingStatus").alias("FastingStatus")
        )
        taken_at = visit_time(iso_date(F.col("b.sessionDate")), ingested_at).alias("TakenAt")
        values = accepted.select("SubmissionID", "SessionID", taken_at, F.explode("b.measurements").alias("m"))
        rejected = decided.where("Reason IS NOT NULL").select(
            *header,
            F.when(F.col("b.measurements").isNotNull(), F.col("b.sessionDate")).alias("SessionDateText"),
            F.col("b.fastingStatus").alias("FastingStatus"),
            "Reason",
        )
        results = {
            "sessions": visits,
            "measurements": values.select(
                "SubmissionID", "SessionID", F.col("m.biomarkerId").alias("BiomarkerID"), F.col("m.value").alias("Value"), "TakenAt"
            ),
            "rejected": rejected,
            # The one number the next batch needs.
            "highest": accepted.agg(F.coalesce(F.max("SessionID").cast("bigint"), F.lit(highest)).alias("SessionID")),
        }
        for name, df in results.items():
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")

    reader = spark.readStream.schema(SUBMISSION_JSON)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    settings = {_STATE_STORE: _ROCKSDB} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)  # a query keeps the settings that it was started with
    try:
        return (
            decisions(reader.json(source), users, sessions, ids, registrations)
            .writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
