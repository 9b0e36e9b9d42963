"""Incremental indexing: change detection against the store, the batch pipeline, and streams of changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.functions.paths import content_type_of, file_name
from gleaner.operators.analytics import global_index
from gleaner.operators.chunking import ChunkConfig, assemble, chunk_documents
from gleaner.operators.embedding import Embedder, embed_distinct
from gleaner.operators.store import MemoryStore, TableStore
from gleaner.runtime import materialize
from gleaner.sources.files import content_hash, extract, scan


#: Paths that share one content hash and are still ordered in one task.
HOT_HASH = 1_000_000


def diff(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """``(kind, path, to_path)`` that lead from the stored files to a snapshot.

    ``snapshot (path, content_hash)``; ``files (path, content_hash, status)``. A new path is
    created, another hash or a status other than indexed is modified, an absent path is
    deleted. A created path whose hash one deleted path had is a rename; of several candidates
    each path takes part in one rename, matched in order of path. Null paths are ignored.
    """
    new = snapshot.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("content_hash").alias("h"))
    old = files.where(F.col("path").isNotNull() & (F.coalesce(F.col("status"), F.lit("pending")) != "deleted"))
    old = old.groupBy("path").agg(F.max(F.struct("content_hash", "status")).alias("o")).select("path", F.col("o.content_hash").alias("oh"), F.col("o.status").alias("s"), F.lit(True).alias("was"))
    both = new.withColumn("is", F.lit(True)).join(old, "path", "full")
    both = both.withColumn(
        "kind",
        F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(~F.col("h").eqNullSafe(F.col("oh")) | (F.coalesce("s", F.lit("pending")) != "indexed"), "modified"),
    ).where(F.col("kind").isNotNull())

    def rank(rows: DataFrame, h: str) -> DataFrame:
        """``rows`` with ``r``, the place of the path among those of the same hash; a hash that very many paths share takes several tasks."""
        most = rows.groupBy(h).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= HOT_HASH:
            return rows.withColumn("r", F.row_number().over(Window.partitionBy(h).orderBy("path")))
        placed = global_index(rows.withColumn("_key", F.struct(h, "path")), "_key").drop("_key")
        first = placed.groupBy(h).agg(F.min("position").alias("_f"))
        return placed.join(first, h).withColumn("r", (F.col("position") - F.col("_f") + 1).cast("int")).drop("position", "_f")

    both = materialize(both.select("kind", "path", "h", "oh"), "df-changed")
    born = rank(both.where("kind = 'created' and h is not null"), "h").select(F.col("path").alias("to_path"), "h", "r")
    died = rank(both.where("kind = 'deleted' and oh is not null"), "oh").select(F.col("path").alias("from_path"), F.col("oh").alias("h"), "r")
    moved = born.join(died, ["h", "r"]).select("from_path", "to_path")
    rest = both.join(moved.select(F.col("to_path").alias("path")), "path", "left_anti").join(moved.select(F.col("from_path").alias("path")), "path", "left_anti")
    return rest.select("kind", "path", F.lit(None).cast("string").alias("to_path")).unionByName(moved.select(F.lit("renamed").alias("kind"), F.col("from_path").alias("path"), "to_path"))


def needs_reindex(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, needs_reindex)`` of every snapshot path: whether its hash is new or differs."""
    old = files.groupBy("path").agg(F.max("content_hash").alias("_h"))
    joined = snapshot.select("path", "content_hash").join(old, "path", "left")
    return joined.select("path", (~F.col("content_hash").eqNullSafe(F.col("_h"))).alias("needs_reindex"))


def latest_per_path(feed: DataFrame, path: str = "path", ts: str = "seen_at", tie: str = "feed_id") -> DataFrame:
    """The last event of each path: what is left of a burst of changes once it has settled."""
    rest = [c for c in feed.columns if c != path]
    return feed.where(F.col(path).isNotNull()).groupBy(path).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("e")).select(path, *(F.col(f"e.`{c}`").alias(c) for c in rest))


def to_events(raw: DataFrame) -> DataFrame:
    """``(kind, path, to_path, ts)`` from raw notifications ``(op, paths array, ts)``; hidden names are left out.

    ``create``, ``modify`` and ``remove`` take the first path, a notification with two paths is
    a rename whatever it is called.
    """
    kind = F.when(F.size("paths") == 2, "renamed").when(F.col("op") == "create", "created").when(F.col("op") == "modify", "modified").when(F.col("op") == "remove", "deleted")
    events = raw.select(kind.alias("kind"), F.get("paths", 0).alias("path"), F.when(F.size("paths") == 2, F.get("paths", 1)).alias("to_path"), "ts")
    return events.where(F.col("kind").isNotNull() & ~file_name(F.col("path")).startswith("."))


def debounced(feed: DataFrame, key: str = "path", ts: str = "seen_at", quiet: str = "500 milliseconds", late: str = "3 days") -> DataFrame:
    """A stream (or table) of changes as one row per burst: changes of a path closer than ``quiet`` are one session."""
    stream = feed.withWatermark(ts, late) if feed.isStreaming else feed
    session = stream.groupBy(F.session_window(ts, quiet).alias("w"), key)
    return session.agg(F.count("*").alias("events"), F.max_by("kind", ts).alias("kind")).select(key, "kind", "events", F.col("w.start").alias("started"), F.col("w.end").alias("settled"))


def windowed_counts(feed: DataFrame, ts: str = "seen_at", length: str = "1 hour", late: str = "3 days") -> DataFrame:
    """Changes per event-time window and kind; late rows within ``late`` are counted in their window."""
    stream = feed.withWatermark(ts, late) if feed.isStreaming else feed
    return stream.groupBy(F.window(ts, length).alias("w"), "kind").agg(F.count("*").alias("events")).select(F.col("w.start").alias("started"), "kind", "events")


#: Up to this many changed files, or else folders that hold changed files, are opened by name.
MAX_LISTED = 2000


@dataclass
class Indexer:
    """Keeps a store in step with a folder: one lazy pipeline over all changed files per run, not per file."""

    store: TableStore | MemoryStore
    embedder: Embedder
    config: ChunkConfig = field(default_factory=ChunkConfig)
    includes: list[str] | None = None
    excludes: list[str] | None = None
    max_size: int | None = 10 << 20
    pdf_reader: Callable | None = None
    captioner: Callable | None = None
    strict_types: bool = False

    def build(self, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Chunks and file records of ``(path, content, content_hash, size_bytes, modified_at, mime_type)``."""
        found = materialize(extract(contents.select("path", "content", "mime_type"), self.pdf_reader, self.captioner), "ix-extracted")
        meta = contents.drop("content")
        docs = found.where("error_message is null").select("path", "text", "elements").join(meta, "path")
        docs = docs.withColumn("content_type", F.when(F.col("mime_type").startswith("image/"), "image_caption").otherwise(content_type_of(F.col("path"), self.strict_types)))
        docs = docs.withColumn("file_id", F.sha2("path", 256)).withColumnsRenamed({"mime_type": "file_mime_type", "size_bytes": "file_size_bytes"})
        pieces = chunk_documents(docs, "text", "content_type", self.config, elements_col="elements")
        chunks = embed_distinct(assemble(pieces, "path", "file_id", "content_hash", "content_type", self.embedder.name), "content", self.embedder)
        chunks = materialize(chunks.drop("path", "modified_at", "content_hash"), "ix-chunks")
        counts = chunks.groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("chunk_count"))
        files = meta.join(found.select("path", "error_message"), "path", "left").join(counts, "path", "left")
        files = files.select(
            F.sha2("path", 256).alias("file_id"), "path", "size_bytes", "mime_type", "content_hash", "modified_at", F.current_timestamp().alias("indexed_at"),
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.when(F.col("error_message").isNull(), "indexed").otherwise("error").alias("status"), "error_message",
        )
        return chunks, files

    def sync(self, root: str, force: bool = False, under: str | None = None) -> DataFrame:
        """Bring the store up to date with a folder (or the part below ``under``); returns what changed.

        Files whose size and time are those of an indexed record are not opened unless ``force``. Files that cannot be extracted get
        an ``error`` record. Everything becomes visible in one commit.
        """
        spark = self.store.spark
        known = self.store.read("files")
        inside = lambda d: d if under is None else d.where((F.col("path") == under) | F.col("path").startswith(under.rstrip("/") + "/"))
        listing = materialize(inside(scan(spark, root, self.includes, self.excludes, self.max_size)), "ix-listing")
        known = inside(known)
        same_stat = listing.join(known.where("status = 'indexed'").select("path", "size_bytes", "modified_at", "content_hash"), ["path", "size_bytes", "modified_at"])
        if force:
            same_stat = same_stat.limit(0)
        to_read = listing.select("path").join(same_stat.select("path"), "path", "left_anti")
        few = [r.path for r in to_read.limit(MAX_LISTED + 1).collect()]
        # a few changed files are opened by name, more by their folders, and only beyond that the whole tree is read
        source, deep = few if 0 < len(few) <= MAX_LISTED else root, True
        if len(few) > MAX_LISTED:
            folders = [r.f for r in to_read.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct().limit(MAX_LISTED + 1).collect()]
            if len(folders) <= MAX_LISTED:
                source, deep = folders, False
        hashed = scan(spark, root, self.includes, self.excludes, self.max_size, content=True, only=source, deep=deep).join(to_read, "path", "left_semi") if few else scan(spark, root, content=True).limit(0)
        hashed = hashed.withColumn("content_hash", content_hash(F.col("content")))
        snapshot = hashed.select("path", "content_hash").unionByName(same_stat.select("path", "content_hash"))
        snapshot = materialize(snapshot, "ix-snapshot")
        changes = diff(snapshot, known)
        if force:
            same = snapshot.select("path").join(changes.select("path"), "path", "left_anti").join(changes.select(F.col("to_path").alias("path")), "path", "left_anti")
            changes = changes.unionByName(same.select(F.lit("modified").alias("kind"), "path", F.lit(None).cast("string").alias("to_path")))
        changes = materialize(changes, "ix-changes")
        self.apply(changes, hashed)
        return changes

    def apply(self, changes: DataFrame, contents: DataFrame) -> None:
        """Apply ``(kind, path, to_path)``; ``contents`` has the data of created and modified paths."""
        if changes.isEmpty():
            return
        fresh = changes.where(F.col("kind").isin("created", "modified")).select("path").distinct()
        chunks, files = self.build(contents.join(fresh, "path", "left_semi").drop("name"))
        moved = changes.where("kind = 'renamed'").select(F.col("path").alias("_from"), F.col("to_path").alias("_to"))
        old_chunks = self.store.read("chunks").join(F.broadcast(moved) if moved.count() <= 100_000 else moved, F.col("file_path") == F.col("_from"))
        old_files = self.store.read("files").join(moved, F.col("path") == F.col("_from"))
        chunks = chunks.unionByName(old_chunks.withColumn("file_path", F.col("_to")).drop("_from", "_to"), allowMissingColumns=True)
        files = files.unionByName(old_files.withColumn("path", F.col("_to")).drop("_from", "_to"), allowMissingColumns=True)
        gone = changes.select("path").unionByName(changes.where("to_path is not null").select(F.col("to_path").alias("path")))
        self.store.replace_files(materialize(gone.distinct(), "ix-gone"), materialize(chunks, "ix-new-chunks"), materialize(files, "ix-new-files"))

    def updates(self, root: str, changes: DataFrame) -> DataFrame:
        """``(event, path, chunks, error)`` of one run: ``started`` for the root, then what became of each path: ``indexed``, ``error`` or ``removed``."""
        started = changes.sparkSession.createDataFrame([("started", root, None, None)], "event string, path string, chunks int, error string")
        now = changes.where("kind <> 'deleted'").select(F.coalesce("to_path", "path").alias("path")).distinct()
        now = now.join(self.store.read("files").select("path", "chunk_count", "status", "error_message"), "path")
        now = now.select(F.when(F.col("status") == "error", "error").otherwise("indexed").alias("event"), "path", F.col("chunk_count").alias("chunks"), F.col("error_message").alias("error"))
        gone = changes.where("kind IN ('deleted', 'renamed')").select(F.lit("removed").alias("event"), "path", F.lit(None).cast("int").alias("chunks"), F.lit(None).cast("string").alias("error"))
        return started.unionByName(now).unionByName(gone)

    def watch(self, root: str, checkpoint: str, interval: str = "500 milliseconds", once: bool = False, on_change: Callable[[DataFrame, int], None] | None = None, on_update: Callable[[DataFrame, int], None] | None = None):
        """A streaming query that compares the folder with the store at every tick; ``on_update`` gets :meth:`updates` of each run that changed something."""

        def tick(_: DataFrame, epoch: int) -> None:
            changes = self.sync(root)
            if on_change is not None:
                on_change(changes, epoch)
            if on_update is not None and not changes.isEmpty():
                on_update(self.updates(root, changes), epoch)

        ticks = self.store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
        return (writer.trigger(once=True) if once else writer.trigger(processingTime=interval)).start()


def consume_feed(spark: SparkSession, feed_dir: str, checkpoint: str, apply: Callable[[DataFrame, int], None], layout: str | None = None):
    """A streaming query over files of change events; each batch is reduced to the last event per path."""
    kinds = layout or "feed_id long, kind string, path string, to_path string, seen_at timestamp, arrived_at timestamp, origin string"
    feed = spark.readStream.schema(kinds).parquet(feed_dir)
    return feed.writeStream.foreachBatch(lambda df, epoch: apply(latest_per_path(df), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
