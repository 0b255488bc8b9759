"""Structured Streaming forms: intake with duplicates removed, late counts, windows, batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.operators import normalize
from vigil.sources import vendor
from vigil.streaming.store import KeyedStore, Opened

#: Lateness up to which rows count for duplicates and windows; later ones are still written by ``accept``.
WATERMARK = "30 days"


def read_raw(spark: SparkSession, path: str, schema, files_at_once: int | None = 1, bytes_at_once: str | None = None) -> DataFrame:
    """A stream of raw rows from a folder of Parquet files: so many files a batch, files up to so many bytes (``"512m"``), or all that are there (null)."""
    rows = spark.readStream.schema(schema)
    if bytes_at_once:
        rows = rows.option("maxBytesPerTrigger", bytes_at_once)
    elif files_at_once:
        rows = rows.option("maxFilesPerTrigger", files_at_once)
    return rows.parquet(path)


def valid_stream(raw: DataFrame) -> DataFrame:
    """Checked and keyed rows without their dead letters."""
    good, _ = normalize.split(normalize.checked(raw))
    return normalize.with_semantic_key(normalize.keyed(good))


def deduplicated_stream(raw: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """The fast path: duplicates within the watermark are dropped by state that expires."""
    rows = valid_stream(raw).withColumn("event_time", F.col("observed_at").cast("timestamp"))
    return rows.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["semantic_key"])


#: What a store of accepted keys holds.
KEYS = "key string, observed_at timestamp_ntz"


def known_keys(store: KeyedStore, rows: DataFrame, batch: int) -> tuple[DataFrame, Opened]:
    """Semantic and event keys among the rows' that earlier batches accepted. A semantic key holds its time, so files of other times stay closed."""
    none = F.lit(None).cast("timestamp_ntz")
    semantic = rows.select(F.concat(F.lit("s|"), "semantic_key").alias("key"), F.col("observed_at").alias("since"), F.col("observed_at").alias("until"))
    event = rows.select(F.concat(F.lit("e|"), "event_key").alias("key"), none.alias("since"), none.alias("until"))
    found, opened = store.look_up(semantic.unionByName(event).distinct(), batch, KEYS)
    kind, rest = F.substring("key", 1, 1), F.expr("substring(key, 3)")
    return found.select(F.when(kind == "s", rest).alias("semantic_key"), F.when(kind == "e", rest).alias("event_key")), opened


def stored_keys(accepted: DataFrame) -> DataFrame:
    """Both keys of accepted rows, as the store holds them."""
    semantic = F.struct(F.concat(F.lit("s|"), "semantic_key").alias("key"), F.col("observed_at").alias("observed_at"))
    event = F.struct(F.concat(F.lit("e|"), "event_key").alias("key"), F.lit(None).cast("timestamp_ntz").alias("observed_at"))
    return accepted.select(F.explode(F.array(semantic, event)).alias("k")).select("k.*")


def accept(raw: DataFrame, path: str, checkpoint: str, dead_path: str | None = None) -> StreamingQuery:
    """The exact path: each batch leaves out what earlier ones accepted, whatever its age, and opens only the files of keys that may hold its own.

    A batch that is run again writes the same folder again, so nothing is doubled. Rows are in ``path/batch=n``, the store of keys beside it.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        store = KeyedStore(spark, f"{path}-keys", "observed_at")
        checked = normalize.checked(df).persist()
        try:
            good, dead = normalize.split(checked)
            keyed = normalize.with_semantic_key(normalize.keyed(good))
            seen, _ = known_keys(store, keyed, number)
            rows = normalize.deduplicated(keyed.drop("semantic_key"), seen)
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
            store.append(stored_keys(spark.read.schema(rows.schema).parquet(f"{path}/batch={number}")), number)
            if dead_path:
                dead.write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        finally:
            checked.unpersist()

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def map_lines(lines: DataFrame, source: str, path: str) -> StreamingQuery:
    """Vendor exports as they come (``vendor.stream_lines``): raw events with ``mapping_error`` in ``path/events``, lines that aren't JSON in ``path/broken``.

    A batch that is run again writes the same folders again.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()  # texts of broken lines alone can't be asked of a JSON source
        try:
            rows = vendor.mapped({source: df.where("_corrupt IS NULL").drop("_corrupt")})
            rows.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
            broken = df.where("_corrupt IS NOT NULL").select(F.lit(source).alias("source"), F.col("_corrupt").alias("line"))
            broken.write.mode("overwrite").parquet(f"{path}/broken/batch={number}")
        finally:
            df.unpersist()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def accept_batches(incoming: DataFrame, accepted: DataFrame, *order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batches by idempotency key: new ones, repeats of the same payload, and conflicts of another payload. Every row is in one of them.

    Of rows with one key in ``incoming`` the first by ``order``, then payload, is held against ``accepted`` and the others against
    the payload that is kept. Null keys and payloads are values like others. ``accepted`` has each key once.
    """
    rows = incoming.select("*", F.struct(*incoming.columns).alias("_row"))
    first = Window.partitionBy("idempotency_key").orderBy(*order, "payload_sha256")
    rows = rows.withColumn("_nth", F.row_number().over(first)).withColumn("_first", F.first(F.struct("payload_sha256")).over(first))
    known = accepted.select(F.col("idempotency_key").alias("_key"), F.struct("payload_sha256").alias("_known"))
    rows = rows.join(known, F.col("idempotency_key").eqNullSafe(F.col("_key")), "left")
    fresh = F.col("_known").isNull() & (F.col("_nth") == 1)
    equal = F.coalesce("_known", "_first")["payload_sha256"].eqNullSafe(F.col("payload_sha256"))
    pick = lambda which: rows.where(which).select("_row.*")
    return pick(fresh), pick(~fresh & equal), pick(~fresh & ~equal)


def accept_batch_stream(batches: DataFrame, root: str, *order: str) -> StreamingQuery:
    """The same for a stream of batches: accepted ones in ``root/accepted``, with ``kind`` all others in ``root/refused``; keys in a store."""

    def run(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        store, df = KeyedStore(spark, f"{root}/keys"), df.persist()
        try:
            key = F.coalesce(F.concat(F.lit("="), "idempotency_key"), F.lit("null")).alias("key")
            none = F.lit(None).cast("timestamp_ntz")
            known, _ = store.look_up(df.select(key, none.alias("since"), none.alias("until")).distinct(), number, "key string, idempotency_key string, payload_sha256 string")
            new, repeats, conflicts = accept_batches(df, known, *order)
            new.write.mode("overwrite").parquet(f"{root}/accepted/batch={number}")
            repeats.withColumn("kind", F.lit("repeat")).unionByName(conflicts.withColumn("kind", F.lit("conflict"))).write.mode("overwrite").parquet(f"{root}/refused/batch={number}")
            store.append(spark.read.schema(new.schema).parquet(f"{root}/accepted/batch={number}").select(key, "idempotency_key", "payload_sha256"), number)
        finally:
            df.unpersist()

    return batches.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()


def history_stream(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Distinct resources per principal and two-hour window, each window once it is complete."""
    timed = events.withColumn("event_time", F.col("observed_at").cast("timestamp")).withWatermark("event_time", watermark)
    return timed.groupBy(F.window("event_time", "2 hours"), "principal_key").agg(F.array_sort(F.collect_set("resource_key")).alias("resources")).select("principal_key", F.col("window.start").alias("window_start"), "resources")


def dead_letter_stream(raw: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Dead letters per source and day."""
    _, dead = normalize.split(normalize.checked(raw))
    timed = dead.withColumn("event_time", F.col("received_at").cast("timestamp")).withWatermark("event_time", watermark)
    return timed.groupBy("source", F.window("event_time", "1 day")).agg(F.count(F.lit(1)).alias("dead_letters")).select("source", F.col("window.start").alias("day"), "dead_letters")


def index_feed(documents: DataFrame, index: DataFrame | None) -> DataFrame:
    """Search documents whose event isn't indexed yet."""
    return documents if index is None else documents.join(index.select("event_id"), "event_id", "left_anti")


def changed(signature: DataFrame, last: tuple[int, int] | None) -> bool:
    """Whether inputs differ from those of the last run; the signature is one row."""
    row = signature.first()
    return last is None or (row.n, row.hash) != last


def run_if_changed(signature: DataFrame, last: tuple[int, int] | None, job: Callable[[], None]) -> tuple[int, int]:
    """Runs the job unless nothing changed; returns the signature to keep."""
    row = signature.first()
    if last is None or (row.n, row.hash) != last:
        job()
    return row.n, row.hash


def stale(runs: DataFrame, job: str = "stats") -> DataFrame:
    """Whether a job's last run is before the last of the runs it depends on. ``runs`` has job and finished_at."""
    return runs.agg((F.coalesce(F.max(F.when(F.col("job") != job, F.col("finished_at"))) > F.max(F.when(F.col("job") == job, F.col("finished_at"))), F.max(F.when(F.col("job") == job, F.col("finished_at"))).isNull())).alias("stale"))
