"""Structured Streaming: continuous ingest of crawl rows, dedupe, change feed,
throughput and per-URL attempt counters.

``CrawlStore`` keeps a crawl as a base table plus an append-only change log
(``log/stream=S/batch_id=N``, S naming the source that a stream reads).  A micro-batch only writes the rows it changes (new
URLs, discovered URLs now crawled), so the cost of a batch is proportional to
the batch, not to the crawl; the table itself is never rewritten.  Each batch
folder is written to a temporary name and renamed when complete, and a batch
whose folder already exists is skipped, so a replayed micro-batch (restart
after a failure) is a no-op: the sink is idempotent per stream and batch id.

Reading the current table resolves every URL to its first crawled version
(base before log, earlier batch before later) with one aggregate per URL
(``min_by``, partially aggregated, so a hot URL is pre-reduced on the map
side).  A micro-batch resolves only its own URLs: base and log are
semi-joined with the batch's URL set first (the small side AQE broadcasts),
so a batch never aggregates the whole table, and of the base only the buckets (hash of
the URL, one folder each) that the batch touches are read.

After ``COMPACT`` batches the log is merged into a new base (``compact``): base and pointer
are written first, then the merged batch folders move out of the log, so the table can be
read at any moment in between and a batch costs the same however many came before it.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.operators.state import dedupe_batch
from sitegraph.session import scratch_path
from sitegraph.sources.io import _fs, _write_pointer, current_version

#: Folders of the base, by hash of the URL, and batches after which the log is merged into it.
BUCKETS = 64
COMPACT = 32


def _bucket(url) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


class CrawlStore:
    """A crawl table as base + change log in one folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    @property
    def log_path(self) -> str:
        return f"{self.folder}/log"

    @property
    def merged_path(self) -> str:
        return f"{self.folder}/merged"

    def create(self, base: DataFrame) -> "CrawlStore":
        self._write_base(base.withColumn("change", F.lit(None).cast("string")))
        return self

    def _write_base(self, rows: DataFrame) -> None:
        version = f"base-{uuid.uuid4().hex}"
        # the schema apart: a base without rows has no files
        self.spark.createDataFrame([], rows.schema).write.parquet(f"{self.folder}/{version}-schema")
        bucketed = rows.withColumn("bucket", _bucket("url"))
        bucketed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{version}")
        _write_pointer(self.spark, self.folder, version)

    def base(self, buckets: list[int] | None = None) -> DataFrame:
        """The base table, or those buckets of it."""
        version = current_version(self.spark, self.folder)
        schema = self.spark.read.parquet(f"{self.folder}/{version}-schema").schema.add("bucket", "integer")
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{version}")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def _exists(self, path: str) -> bool:
        fs, p = _fs(self.spark, path)
        return fs.exists(p)

    def _batches(self, path: str) -> list[str]:
        fs, p = _fs(self.spark, f"{path}/stream=*/batch_id=*")
        return [f.getPath().toString() for f in fs.globStatus(p) or []]

    def log(self, merged: bool = True) -> DataFrame | None:
        """The change log, with or without what is merged into the base."""
        paths = [p for p in ([self.log_path, self.merged_path] if merged else [self.log_path]) if self._batches(p)]
        parts = [self.spark.read.parquet(p) for p in paths]
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def compact(self) -> int:
        """Merge the log into a new base; returns the number of batches merged."""
        batches = self._batches(self.log_path)
        if not batches:
            return 0
        self._write_base(self.current())
        for path in batches:
            fs, src = _fs(self.spark, path)
            dst = _fs(self.spark, f"{self.merged_path}/{src.getParent().getName()}/{src.getName()}")[1]
            fs.mkdirs(dst.getParent())
            if not fs.rename(src, dst):
                raise OSError(f"cannot rename {src} to {dst}")
        return len(batches)

    def current(self, only: DataFrame | None = None) -> DataFrame:
        """The crawl table now: every URL at its first crawled version.
        ``only`` (a frame with ``url``) restricts the resolution to those URLs
        before any aggregation."""
        log = self.log(merged=False)
        if only is None:
            base = self.base()
        else:
            keys = only.select("url").distinct()
            buckets = [r[0] for r in keys.select(_bucket("url")).distinct().collect()]  # at most BUCKETS
            base = self.base(buckets).join(keys, "url", "left_semi")
            log = None if log is None else log.join(keys, "url", "left_semi")
        if log is None:
            return base
        cols = [c for c in base.columns if c not in ("url", "change")]
        extra = [c for c in log.columns if c not in base.columns and c not in ("url", "change", "batch_id", "stream", "_at")]
        b = base.select("url", *cols, *[F.lit(None).alias(c) for c in extra],
                        "change", F.lit(-1).cast("bigint").alias("_batch"))
        lg = log.select("url", *[F.col(c) if c in log.columns else F.lit(None).alias(c) for c in cols],
                        *extra, "change", F.col("_at").alias("_batch"))
        rows = b.unionByName(lg)
        rank = F.struct(F.col("status_code").isNull().alias("_pending"), F.col("_batch"))
        best = F.min_by(F.struct(*cols, *extra, "change"), rank)
        return rows.groupBy("url").agg(best.alias("_r")).select("url", "_r.*")

    def _batch_path(self, table: str, stream: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/stream={stream}/batch_id={batch_id}"

    def _publish(self, df: DataFrame, target: str) -> None:
        """Write ``df`` under a temporary name, then rename it to ``target`` in one step."""
        tmp = f"{self.folder}/_work/{uuid.uuid4().hex}"
        df.write.parquet(tmp)
        fs, src = _fs(self.spark, tmp)
        dst = _fs(self.spark, target)[1]
        fs.mkdirs(dst.getParent())
        if fs.exists(dst) or not fs.rename(src, dst):
            raise OSError(f"cannot rename {tmp} to {target}")

    def _written(self) -> int:
        """Number of batches so far: the place of the next one."""
        return len(self._batches(self.log_path)) + len(self._batches(self.merged_path))

    def _applied(self, stream: str, batch_id: int) -> bool:
        return any(self._exists(self._batch_path(t, stream, batch_id)) for t in ("log", "merged"))

    def _compact_at_times(self) -> None:
        if len(self._batches(self.log_path)) >= COMPACT:
            self.compact()

    def _changes(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """The rows that are new or complete a discovered URL (first write wins)."""
        base_only = [c for c in known.columns if c not in rows.columns and c not in ("url", "change")]
        k = known.select("url", F.col("status_code").alias("_known_status"), F.lit(True).alias("_known"), *base_only)
        j = rows.join(k, "url", "left")
        return j.filter(F.col("_known").isNull() | F.col("_known_status").isNull()).withColumn(
            "change", F.when(F.col("_known").isNull(), F.lit("new")).otherwise(F.lit("updated"))) \
            .drop("_known", "_known_status")

    def apply(self, batch: DataFrame, batch_id: int, seq: str = "seq", stream: str = "main") -> int:
        """First-write-wins upsert of one micro-batch; returns rows logged.
        Replays of an already applied batch of the same stream do nothing."""
        if self._applied(stream, batch_id):
            return 0
        target = self._batch_path("log", stream, batch_id)
        fresh = dedupe_batch(batch, seq).drop(seq)
        out = self._changes(fresh, self.current(only=fresh))
        self._publish(out.withColumn("_at", F.lit(self._written()).cast("bigint")), target)
        self._compact_at_times()
        return 1

    def edges(self) -> DataFrame | None:
        path = f"{self.folder}/edges"
        if not self._exists(path):
            return None
        return self.spark.read.parquet(path).select("url_from", "url_to").distinct()

    def apply_fetches(self, fetches: DataFrame, batch_id: int, settings, robots: DataFrame | None = None, *,
                      order: str, stream: str = "main") -> int:
        """One crawl step: page and redirect rows upserted (first write wins),
        link targets not yet known inserted as discovered, and (with
        ``unique_inlinks``) the batch's unique edges recorded.  Idempotent per
        stream and batch id like :meth:`apply`.  ``order``: the column that says in which
        order the fetches arrived.  The bodies are read once, into a written table of items
        and link arrays; rows and links are taken from that."""
        from sitegraph.operators.crawl import crawl_rows
        from sitegraph.operators.extract import links_of, read_pages

        if self._applied(stream, batch_id):
            return 0
        target = self._batch_path("log", stream, batch_id)
        work = f"{self.folder}/_work/{uuid.uuid4().hex}"
        written = lambda df, name: (df.write.parquet(f"{work}/{name}"), self.spark.read.parquet(f"{work}/{name}"))[1]
        read = written(read_pages(fetches, settings), "read")
        rows = written(dedupe_batch(crawl_rows(read, settings, order, robots), "_seq").drop("_seq"), "rows")
        links = written(links_of(read, settings, robots).distinct(), "links")
        targets = links.select(F.col("url_to").alias("url")).distinct()
        known = self.current(only=rows.select("url").unionByName(targets))
        discovered = (targets.join(known.select("url"), "url", "left_anti")
                      .join(rows.select("url"), "url", "left_anti")
                      .withColumn("change", F.lit("discovered")))
        out = self._changes(rows, known).unionByName(discovered, allowMissingColumns=True)
        if settings.has("unique_inlinks") and not self._exists(self._batch_path("edges", stream, batch_id)):
            self._publish(links, self._batch_path("edges", stream, batch_id))
        self._publish(out.withColumn("_at", F.lit(self._written()).cast("bigint")), target)
        fs, p = _fs(self.spark, work)
        fs.delete(p, True)
        self._compact_at_times()
        return 1

    def stream_of(self, source: str) -> tuple[str, str]:
        """Identity of the stream that reads ``source``, and its checkpoint in this store:
        another source, or a second run of this one, never meets foreign batch ids."""
        stream = hashlib.md5(source.rstrip("/").encode()).hexdigest()[:16]
        return stream, f"{self.folder}/checkpoint/{stream}"


def run_crawl(spark: SparkSession, source: str, store: CrawlStore, settings, robots: DataFrame | None = None, *,
              order: str, max_files: int = 1) -> CrawlStore:
    """Continuous crawl ingest: a file stream of fetches, one crawl step per
    micro-batch, until no input is left.  A later run goes on where this one ended."""
    name, checkpoint = store.stream_of(source)
    stream = _file_stream(spark, source, max_files)
    q = (stream.writeStream
         .foreachBatch(lambda df, bid: store.apply_fetches(df, bid, settings, robots, order=order, stream=name))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return store


def write_chunks(chunks: list[DataFrame], folder: str) -> str:
    """Write frames one after the other into a source folder (file
    modification order = chunk order, which is the order a file stream reads)."""
    for df in chunks:
        df.write.mode("append").parquet(folder)
    return folder


def _file_stream(spark: SparkSession, folder: str, max_files: int) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def run_ingest(spark: SparkSession, source: str, store: CrawlStore, seq: str = "seq",
               max_files: int = 2, checkpoint: str | None = None, on_batch=None) -> CrawlStore:
    """Stream crawl rows from ``source`` into ``store`` until no input is left.
    The checkpoint belongs to the store and the source (unless one is given, which
    then names the stream): a restart resumes after the last committed micro-batch; a batch that was written but not committed is
    replayed and skipped by the store."""
    name, own = store.stream_of(checkpoint or source)
    checkpoint = checkpoint or own
    stream = _file_stream(spark, source, max_files)

    def step(df, bid):
        store.apply(df, bid, seq, name)
        if on_batch is not None:
            on_batch(bid)

    q = (stream.writeStream.foreachBatch(step)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return store


def run_dedupe(spark: SparkSession, source: str, order: str, key: str = "url", ts: str | None = None,
               delay: str | None = None, max_files: int = 2, folder: str | None = None) -> DataFrame:
    """First write wins as a pure stream: of each key the row that arrives first, by micro-batch
    and inside one by ``order``.  The state is a flag per key.  With an event time ``ts`` and a
    ``delay`` a row counts for ``delay`` from its time on: a row of its key after that is a first
    one again, and the key leaves the state when the watermark (``delay`` behind the latest row)
    has passed, so the state is bounded by the keys of a few delays.  ``folder`` keeps sink and
    checkpoint: a later run goes on where this one ended."""
    folder = folder or scratch_path(spark, "dedupe")
    stream = _file_stream(spark, source, max_files)
    schema = stream.schema
    timed = ts is not None and delay is not None
    if timed:
        stream = stream.withWatermark(ts, delay)
        wait = pd.Timedelta(delay).value // 1_000_000

    def first(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None  # until when (ms); for ever without an event time
        if known is not None and not timed:
            return
        rows = []
        for f in frames:
            fresh = f if known is None else f[f[ts] >= pd.Timestamp(known, unit="ms")]
            if len(fresh):
                rows.append(fresh.loc[[fresh[order].idxmin()]])
        if not rows:
            return
        best = min(rows, key=lambda r: r[order].iloc[0])
        until = int(best[ts].iloc[0].value // 1_000_000) + wait if timed else 0
        state.update((until,))
        if timed:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield best

    kept = stream.groupBy(key).applyInPandasWithState(
        first, schema, "until bigint", "append", "EventTimeTimeout" if timed else "NoTimeout")
    q = (kept.writeStream.format("parquet").option("path", f"{folder}/rows")
         .option("checkpointLocation", f"{folder}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def throughput(df: DataFrame, ts: str = "ts", window: str = "1 hour") -> DataFrame:
    """Crawled URLs per time window (batch form)."""
    return (df.groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("urls"))
            .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "urls"))


def _latest_per_key(sink_df: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in sink_df.columns if c not in keys and c != "batch_id"]
    best = F.max_by(F.struct(*cols), F.col("batch_id"))
    return sink_df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def _update_sink(spark: SparkSession, name: str):
    sink = scratch_path(spark, name)

    def write(df, bid):
        df.withColumn("batch_id", F.lit(bid).cast("bigint")).write.mode("append").parquet(sink)

    return sink, write


def run_throughput(spark: SparkSession, source: str, ts: str = "ts", window: str = "1 hour",
                   watermark: str = "1 hour", max_files: int = 1) -> DataFrame:
    """Streaming throughput: watermark + event-time window, update mode; the
    sink keeps every update, the final answer is the last update per window."""
    sink, write = _update_sink(spark, "throughput-sink")
    agg = (_file_stream(spark, source, max_files).withWatermark(ts, watermark)
           .groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("urls"))
           .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                   F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "urls"))
    q = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", scratch_path(spark, "throughput-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return _latest_per_key(spark.read.parquet(sink), ["window_start", "window_end"])


def attempt_counts(rows: DataFrame, url: str, outcome: str, ok_value: str, ts: str, seq: str) -> DataFrame:
    """``url, failures, successes, early`` of a set of attempts; early: the failures before the
    first success by (ts, seq), all if there is none.  Aggregates and one join that AQE may split,
    so neither many URLs nor a hot one need more than their rows."""
    at = F.struct(F.col(ts).isNull(), F.col(ts), F.col(seq).isNull(), F.col(seq))  # nulls last
    each = rows.select(F.col(url).alias("url"), F.coalesce(F.col(outcome) == ok_value, F.lit(False)).alias("ok"), at.alias("at"))
    total = each.groupBy("url").agg(F.count_if(~F.col("ok")).alias("failures"), F.count_if("ok").alias("successes"),
                                    F.min(F.when(F.col("ok"), F.col("at"))).alias("first"))
    first = total.where("successes > 0").select(F.col("url").alias("key"), "first")
    late = each.where("not ok").join(first, F.col("url").eqNullSafe(F.col("key"))).where("at >= first") \
        .groupBy("key").agg(F.count("*").alias("late"))
    return total.join(late, F.col("url").eqNullSafe(F.col("key")), "left").select(
        "url", "failures", "successes", (F.col("failures") - F.coalesce("late", F.lit(0))).alias("early"))


def run_attempt_counter(spark: SparkSession, source: str, url: str = "url", outcome: str = "outcome",
                        ok_value: str = "ok", ts: str = "ts", seq: str = "event_id", max_files: int = 1,
                        max_retries: int = 5, folder: str | None = None) -> DataFrame:
    """Per-URL attempt counters over a stream of attempts, with ``over_limit`` by the
    rule of the failure rows (``failed_urls``: more failures before the first success
    than the retry limit).

    Attempts count in the order they arrive: micro-batch by micro-batch, inside one by (ts, seq).
    Each micro-batch emits three counts of each URL it touched: its failures, successes, and
    failures before its first success.  They add up: a URL's failures before its first success
    are those of its batches up to the first with a success.  ``folder`` keeps them and the
    checkpoint, so a later run reads only the files that are new, and a replayed batch
    overwrites its own counts."""
    folder = folder or scratch_path(spark, "attempts")
    q = (_file_stream(spark, source, max_files).writeStream
         .foreachBatch(lambda df, bid: attempt_counts(df, url, outcome, ok_value, ts, seq)
                       .write.mode("overwrite").parquet(f"{folder}/counts/batch_id={bid}"))
         .option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    counts = spark.read.parquet(f"{folder}/counts")
    ended = counts.where("successes > 0").groupBy(F.col("url").alias("key")).agg(F.min("batch_id").alias("ended"))
    before = F.sum(F.when(F.col("ended").isNull() | (F.col("batch_id") <= F.col("ended")), F.col("early")).otherwise(0))
    return counts.join(ended, F.col("url").eqNullSafe(F.col("key")), "left").groupBy(F.col("url").alias(url)).agg(
        F.sum("failures").alias("failures"), F.sum("successes").alias("successes"), (before > max_retries).alias("over_limit"))
