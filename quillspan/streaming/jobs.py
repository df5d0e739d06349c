"""Structured Streaming forms of the incremental jobs; each has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillspan.operators.history import entry_postings
from quillspan.operators.questions import flag_phrases
from quillspan.session import DEFAULTS, cut_lineage, remove_folder

ABANDON_MINUTES = 60
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
NONE_USED = -1  # the log's value where the fallback is shown

OUTCOME_SCHEMA = "conv_id long, revision long, outcome string, used long, n_attempts long, abandoned boolean"


def stream_table(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def write_stream(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet folder until the input at hand is used up.

    A stream takes its session's settings when it starts. State machines need a store of several column families, which
    Spark's default store is not, so the store is set for the start whatever session the caller brings.
    """
    conf = df.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, DEFAULTS[STATE_STORE])
    try:
        return (
            df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(target)
        )
    finally:
        conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)


def write_batches(df: DataFrame, job: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator on every micro-batch.

    Each batch owns the folder of its number, so a batch that is replayed after
    a failure replaces its own output and nothing else.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def flagged_questions(questions: DataFrame, terms: list[str]) -> DataFrame:
    """Stateless: incoming questions meet the static phrase list."""
    return flag_phrases(questions, terms)


def resolver(quiet_ms: int) -> StatefulProcessor:
    """The processor of ``resolve_stream``.

    Its class is made here so that it travels by value: the process that Spark starts beside the driver to set a processor
    up knows neither the job's folder nor the files sent to the workers.
    """

    class Resolver(StatefulProcessor):
        """Two attempts decide a question: the first that is ok, else the fallback.

        State of a question: its attempts so far (a list of at most one between batches) while it is open, and a mark once it
        is decided, so that what comes later is not taken for a first attempt. An event timer, set ``quiet`` after the
        question's newest row, takes either away; a question that is still open then is reported as abandoned.
        """

        def __init__(self, quiet_ms: int) -> None:
            self.quiet_ms = quiet_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.attempts = handle.getListState("attempts", "turn long, verdict string")
            self.decided = handle.getValueState("decided", "n long")

        def _outcome(self, key, attempts: list[tuple], abandoned: bool) -> Row:
            used = next((turn for turn, verdict in attempts if verdict == "ok"), NONE_USED)
            n = len(attempts) if used == NONE_USED else [turn for turn, _ in attempts].index(used) + 1
            return Row(conv_id=key[0], revision=n, outcome="fallback" if used == NONE_USED else "ok", used=used, n_attempts=n,
                       abandoned=abandoned)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            came = list(rows)
            newest = max(int(r["at"].timestamp() * 1000) for r in came)
            timers = list(self.handle.listTimers())
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max([newest + self.quiet_ms, *timers]))
            if self.decided.exists():
                return
            attempts = [(r[0], r[1]) for r in self.attempts.get()] + [(r["turn"], r["verdict"]) for r in came]
            attempts = sorted(attempts)[:2]
            if attempts[0][1] == "ok" or len(attempts) == 2:
                self.attempts.clear()
                self.decided.update((len(attempts),))
            else:
                self.attempts.put(attempts)
            yield self._outcome(key, attempts, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            open_attempts = [(r[0], r[1]) for r in self.attempts.get()]
            self.attempts.clear()
            self.decided.clear()
            if open_attempts:
                yield self._outcome(key, open_attempts, True)

        def close(self) -> None:
            pass

    return Resolver(quiet_ms)


def resolve_stream(attempts: DataFrame, quiet_minutes: int = ABANDON_MINUTES, late: str = "10 minutes") -> DataFrame:
    """Outcome revisions of every question from a stream of (conv_id, turn, verdict, at).

    ``at`` is the event time; rows later than ``late`` are dropped. The state of a question leaves ``quiet_minutes`` of
    event time after its newest row, so the store holds the questions of that stretch only. ``latest_outcomes`` reads the
    log.
    """
    rows = attempts.select("conv_id", "turn", "verdict", "at").withWatermark("at", late)
    return rows.groupBy("conv_id").transformWithState(
        resolver(quiet_minutes * 60_000), OUTCOME_SCHEMA, "Append", "EventTime")


def latest_outcomes(log: DataFrame) -> DataFrame:
    """(conv_id, outcome, used, n_attempts): the last revision of every question."""
    newest = F.max_by(F.struct("outcome", "used", "n_attempts"), F.struct("revision", "abandoned"))
    last = log.groupBy("conv_id").agg(newest.alias("o")).select("conv_id", "o.*")
    return last.withColumn("used", F.when(F.col("used") != NONE_USED, F.col("used")))


def index_changes(changes: DataFrame) -> DataFrame:
    """Index rows of a batch of history changes (seq, id, op, question, answer).

    The last change of an id within the batch counts. Every id leaves a
    tombstone row (term NULL); ids that were not deleted leave their postings.
    """
    latest = changes.groupBy("id").agg(
        F.max_by(F.struct("op", "question", "answer", "seq"), "seq").alias("c")
    ).select("id", "c.*")
    tombstones = latest.select("id", "seq", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))
    alive = latest.where("op != 'delete'")
    rows = entry_postings(alive).join(alive.select("id", "seq"), "id").select("id", "seq", "term", "tf")
    return tombstones.unionByName(rows)


def compacted(log: DataFrame) -> DataFrame:
    """The log without rows that a later change of their id has replaced; tombstones of living ids stay."""
    last = log.where("term IS NULL").groupBy("id").agg(F.max("seq").alias("seq"))
    return log.select("id", "seq", "term", "tf").join(last, ["id", "seq"], "left_semi")


def compact(spark: SparkSession, target: str) -> None:
    """Replace the batches of a change log by one; run between two runs of the stream, never beside one.

    The compacted rows are complete in a folder of their own before a batch goes; a crash in between leaves rows twice
    with the same number, which ``current_postings`` does not see.
    """
    batches = [r["batch"] for r in spark.read.parquet(target).select("batch").distinct().collect()]  # one number per batch
    rows = cut_lineage(compacted(spark.read.parquet(target)))
    newest = max(batches)
    rows.write.mode("overwrite").parquet(f"{target}/batch={newest}")
    for batch in batches:
        if batch != newest:
            remove_folder(spark, f"{target}/batch={batch}")


def current_postings(log: DataFrame) -> DataFrame:
    """(id, term, tf) that hold now: rows written by the last change of their id."""
    last = log.where("term IS NULL").groupBy("id").agg(F.max("seq").alias("seq"))
    return log.where("term IS NOT NULL").join(last, ["id", "seq"], "left_semi").select("id", "term", "tf").distinct()
