"""Incremental ingest of result files: score board, ledger, first-wins store.

Records arrive as files in a folder. Progress lives in the stream's
checkpoint, so a restart neither loses nor repeats files.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from trialyst.operators.scan import first_by
from trialyst.session import scratch_path
from trialyst.sources.readers import existing


def stream_trials(spark: SparkSession, folder: str, schema, fmt: str = "json", name_glob: str = "*", per_trigger: int | None = None) -> DataFrame:
    """Rows of the files in a folder as they land."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.format(fmt).load(folder)


def stream_scoreboard(trials: DataFrame, by: list[str]) -> DataFrame:
    """Running counts and sums per group; means follow from them at any time."""
    return trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.sum("total_tokens").alias("sum_tokens")
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a page of waiting rows, and the size below which pages are put together.
PAGE_ROWS, SMALL_PAGE = 1000, 100
#: Keys share the state of so many groups: each access to it costs as much as many rows.
GROUP, GROUPS = "__group", 65536


class InOrder(StatefulProcessor):
    """Rows of a group of keys in the order of their event time, whatever order they
    arrive in.

    Rows wait in the state, in sorted pages of at most PAGE_ROWS, until the
    watermark has passed them; a timer at the first row of each page wakes the group. Settling loads a page
    when its first row is next, so a task holds the pages that overlap in time and never a whole
    run. A row behind the watermark is late: it is handed to `late` at once."""

    def __init__(self, row: StructType, keys: list[str], at: str, order: list[str]):
        place = row.fieldNames().index
        self.row, self.keys, self.at, self.order = row, [place(c) for c in keys], place(at), [place(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first bigint, n bigint, k bigint", StructType([StructField("rows", ArrayType(self.row))]))

    def place(self, row: tuple) -> tuple:
        """Sorts rows: their time in whole milliseconds, then the order columns, nulls first."""
        return row[self.at] // 1000, [(row[i] is not None, row[i]) for i in self.order]

    def _take(self, page: tuple) -> list[tuple]:
        rows = [tuple(r) for r in self.waiting.getValue(page)[0]]
        self.waiting.removeKey(page)
        return rows

    def _wait(self, rows: list[tuple]) -> None:
        for page in [tuple(p) for p in self.waiting.keys()]:
            if page[1] < SMALL_PAGE:
                rows = rows + self._take(page)
        rows.sort(key=self.place)
        for i in range(0, len(rows), PAGE_ROWS):
            part, k = rows[i : i + PAGE_ROWS], 0
            first = self.place(part[0])[0]
            while self.waiting.containsKey((first, len(part), k)):
                k += 1
            self.waiting.updateValue((first, len(part), k), (part,))
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark, held = timerValues.getCurrentWatermarkInMs(), []
        for row in rows:
            row = tuple(row)[: len(self.row)]  # without the group
            if self.place(row)[0] <= mark:
                yield from self.late(row)
                continue
            held.append(row)
            if len(held) == PAGE_ROWS:
                self._wait(held)
                held = []
        if held:
            self._wait(held)

    def _due(self, mark: int) -> Iterator[tuple[int, tuple]]:
        """(time, row) of all rows up to the watermark, in order."""
        heap, later = [], []
        for page in sorted(tuple(p) for p in self.waiting.keys() if p[0] <= mark):
            while heap and heap[0][0][0] < page[0]:
                place, _, row = heappop(heap)
                yield place[0], row
            for i, row in enumerate(self._take(page)):
                place = self.place(row)
                if place[0] <= mark:
                    heappush(heap, (place, (*page, i), row))
                else:
                    later.append(row)
        while heap:
            place, _, row = heappop(heap)
            yield place[0], row
        if later:
            self._wait(later)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.settle(self._due(timerValues.getCurrentWatermarkInMs()))

    def settle(self, rows: Iterator[tuple[int, tuple]]) -> Iterator[Row]:
        raise NotImplementedError

    def late(self, row: tuple) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Ledger(InOrder):
    """The state of a run is what it has consumed, besides the calls that wait."""

    def init(self, handle):
        super().init(handle)
        self.used = handle.getMapState("used", StructType([self.row[i] for i in self.keys]), "consumed bigint")

    def settle(self, rows, late=False):
        before, now = {}, {}
        for _, (run, seq, _, tokens, budget) in rows:
            if run not in now:
                known = self.used.getValue((run,))
                before[run] = now[run] = known[0] if known else 0
            now[run] = used = now[run] + (tokens or 0)
            yield Row(run_id=run, seq=seq, tokens=tokens, consumed=used, budget=budget, exhausted=used >= budget, overshoot=used > budget, late=late)
        for run, used in now.items():
            if used != before[run]:
                self.used.updateValue((run,), (used,))

    def late(self, row):
        return self.settle([(0, row)], True)


class _First(InOrder):
    """The state of a key is when its first record was, until the delay is over. The keys of a group share one value."""

    def __init__(self, row, keys, at, order, delay_ms: int):
        super().__init__(row, keys, at, order)
        self.delay = delay_ms

    def init(self, handle):
        super().init(handle)
        entry = StructType([StructField("key", StructType([self.row[i] for i in self.keys])), StructField("at", LongType())])
        self.firsts = handle.getValueState("firsts", StructType([StructField("keys", ArrayType(entry))]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        known = self.firsts.get()
        firsts = {tuple(k): at for k, at in known[0]} if known else {}
        before = dict(firsts)
        yield from self.settle(self._due(mark), firsts)
        # all rows up to here are settled, and the next of a key whose delay is over is a first one
        firsts = {k: at for k, at in firsts.items() if at + self.delay > mark}
        if firsts and firsts != before:
            self.firsts.update(([(k, at) for k, at in firsts.items()],))
            self.handle.registerTimer(min(firsts.values()) + self.delay)
        elif known and not firsts:
            self.firsts.clear()

    def settle(self, rows, firsts):
        for at, row in rows:
            key = tuple(row[i] for i in self.keys)
            known = key in firsts and at < firsts[key] + self.delay
            if not known:
                firsts[key] = at
            yield self._told(row, "duplicate" if known else "first")

    def late(self, row):
        yield self._told(row, "late")

    def _told(self, row, status):
        return Row(**dict(zip(self.row.fieldNames(), row, strict=True)), status=status)


def _in_order(stream: DataFrame, keys: list[str], processor: InOrder, out: StructType) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # timers need it
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int")
    return stream.withColumn(GROUP, group).groupBy(GROUP).transformWithState(processor, out, "append", "eventTime")


def _seen(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """The watermark over the event time, whose column becomes a plain one of microseconds: Spark itself would
    drop late rows before they can be told, and Python takes numbers faster than timestamps."""
    marked = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    return marked.withColumn(event_time, F.unix_micros(event_time))


def stream_ledger(calls: DataFrame, budgets: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Consumption of each run after each call, in the order of ``ts`` and then
    ``seq``, in whatever order files and rows arrive: a call is settled once the watermark
    has passed it, so results equal the batch query's. A call that comes
    after that is added to the run's total at once and marked ``late``."""
    known = _seen(calls, "ts", delay).join(budgets, "run_id").select("run_id", "seq", "ts", "tokens", "budget")
    kind = known.schema
    out = StructType(
        [kind["run_id"], kind["seq"], kind["tokens"], StructField("consumed", LongType()), kind["budget"]]
        + [StructField(c, BooleanType()) for c in ("exhausted", "overshoot", "late")]
    )
    return _in_order(known, ["run_id"], _Ledger(kind, ["run_id"], "ts", ["seq"]), out)


def stream_dedupe(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour", order: list[str] | None = None) -> DataFrame:
    """One record per key; with an event time, every record with a ``status``.

    ``first`` is the earliest record of a key, by event time and ``order``, whatever the order of
    arrival; ``duplicate`` one of the same key within the delay after it; ``late`` one
    that arrives behind the watermark and is rejected, as a first one may have gone out. Filter by status for the kept and the
    rejected output. The state of a key ends with the delay."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    rows = _seen(stream, event_time, delay)
    ms = int(stream.sparkSession.sql(f"SELECT unix_millis(timestamp '1970-01-02' + interval {delay}) - unix_millis(timestamp '1970-01-02')").collect()[0][0])
    out = StructType([*rows.schema.fields, StructField("status", StringType())])
    told = _in_order(rows, keys, _First(rows.schema, keys, event_time, order or keys, ms), out)
    return told.withColumn(event_time, F.timestamp_micros(event_time))


BUCKET, BATCH, WHOLE = "__bucket", "__batch", "__whole"
BUCKETS, MOST_FILES = 256, 16


def _current(stored: DataFrame) -> DataFrame:
    """Of each bucket the latest whole copy and what was added after it."""
    stored = stored.withColumn(WHOLE, F.col(WHOLE).cast("boolean"))  # a folder's name is text
    base = stored.filter(WHOLE).groupBy(BUCKET).agg(F.max(BATCH).alias("__base"))
    kept = F.col("__base").isNull() | F.when(F.col(WHOLE), F.col(BATCH) == F.col("__base")).otherwise(F.col(BATCH) > F.col("__base"))
    return stored.join(base, BUCKET, "left").filter(kept)


def read_first(spark: SparkSession, path: str) -> DataFrame:
    """What a first-wins store holds."""
    return _current(spark.read.parquet(path)).drop(BUCKET, BATCH, WHOLE, "__base")


def _compact(spark: SparkSession, path: str, keys: list[str], batch: int, most_files: int) -> None:
    """Write a whole copy of each bucket with too many additions. What the copy
    before it had replaced already is deleted; readers of the last copy still find its files."""
    stored = spark.read.parquet(path)
    full = _current(stored).groupBy(BUCKET).agg(F.countDistinct(BATCH).alias("n"), F.max("__base").alias("base")).filter(F.col("n") > most_files)
    due = {r[BUCKET]: r["base"] for r in full.collect()}  # at most one row per bucket
    if not due:
        return
    rows = _current(stored).filter(F.col(BUCKET).isin(list(due))).drop("__base")
    whole = rows.withColumns({BATCH: F.lit(batch).cast("bigint"), WHOLE: F.lit(True)}).repartition(BUCKET, F.pmod(F.hash(*keys), F.lit(8)))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, BATCH, WHOLE).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket, base in due.items():
        for old in files.globStatus(hadoop(f"{path}/{BUCKET}={bucket}/{BATCH}=*")) if base is not None else []:
            if int(old.getPath().getName().split("=")[1]) < base:
                files.delete(old.getPath(), True)


def ingest_first(
    stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = BUCKETS, most_files: int = MOST_FILES
):
    """Append the first record of every key not stored yet. The store is
    partitioned by a hash of the key and by batch, and a batch reads the keys of the
    buckets it touches only. A batch that is replayed after a failure writes the same
    partitions again. Buckets with more than ``most_files`` additions are put together, so their number of files
    stays bounded."""

    def store(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = first_by(batch, keys, [F.col(c) for c in order]).withColumns({BUCKET: bucket, BATCH: F.lit(n).cast("bigint"), WHOLE: F.lit(False)})
        if existing(spark, [f"{path}/{BUCKET}=*"]):
            touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most one number per bucket
            earlier = spark.read.parquet(path).filter((F.col(BATCH) < n) & F.col(BUCKET).isin(touched))
            new = new.join(_current(earlier).select(*keys), keys, "left_anti")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, BATCH, WHOLE).parquet(path)
        if existing(spark, [f"{path}/{BUCKET}=*"]):
            _compact(spark, path, keys, n, most_files)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is now and return its result. Append
    results go to files; complete ones overwrite a small table per batch."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path)
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path))
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
