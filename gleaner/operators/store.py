"""Tables of files and chunks that can be upserted, renamed and deleted from, on plain parquet.

Rows lie in ``buckets`` parts by a hash of the path, each part in one or more folders. Rows of new keys
are appended as a further folder of their part; parts in which rows are replaced or removed, and parts
of more than ``MAX_FOLDERS`` folders, are written anew. Then one small manifest is replaced that names
the folders of every part of both tables; readers take the manifest once, so they see the state before or after
a change and never a mixture. The number of parts is chosen from the first rows unless given, and
:meth:`TableStore.rebucket` changes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.operators.fulltext import StoredIndex

KEYS = {"chunks": "file_path", "files": "path"}
#: Tasks that share the rows of one bucket when it is written, and folders of a bucket before they are joined.
WRITERS, MAX_FOLDERS = 8, 8
#: Buckets of a small store, and rows of a bucket aimed at in a large one.
MIN_BUCKETS, BUCKET_ROWS = 16, 2_000_000
LAYOUT = {"chunks": schema.CHUNKS, "files": schema.FILES}


class TableStore:
    """A store below a folder of any file system that Spark can reach; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        found = self._read_manifest()
        self._given, self.buckets = buckets, (found or {}).get("buckets") or buckets or MIN_BUCKETS
        if not found:
            self._fs.mkdirs(self._path(self.root))
            self._commit({"buckets": buckets, "version": 0, "chunks": {}, "files": {}})

    # ---- manifest

    def _read_manifest(self) -> dict | None:
        at = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        tmp, at = self._path(f"{self.root}/.CURRENT-{uuid.uuid4().hex}"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(tmp, at, options)

    # ---- reading

    def read(self, name: str) -> DataFrame:
        """The current rows of ``chunks`` or ``files``."""
        return self._scan(name, None)

    def _scan(self, name: str, only: set[int] | None) -> DataFrame:
        paths = [p for b, ps in self._read_manifest()[name].items() if only is None or int(b) in only for p in ps]
        if not paths:
            return self.spark.createDataFrame([], LAYOUT[name])
        return self.spark.read.schema(LAYOUT[name]).parquet(*paths)

    def _bucket(self, key) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _bucket_of(self, path: str) -> int:
        return self.spark.range(1).select(self._bucket(F.lit(path)).alias("b")).first().b

    def chunks_of(self, path: str) -> DataFrame:
        """Chunks of one file; only its bucket is read and the filter reaches the scan."""
        return self._scan("chunks", {self._bucket_of(path)}).where(F.col("file_path") == path)

    def file(self, path: str) -> DataFrame:
        return self._scan("files", {self._bucket_of(path)}).where(F.col("path") == path).limit(1)

    # ---- writing

    def _write(self, name: str, rows: DataFrame, touched: set[int], manifest: dict) -> None:
        """Write rows into their buckets; those touched hold nothing else then, the others gain a folder."""
        folder = f"{self.root}/{name}-{manifest['version']}-{uuid.uuid4().hex[:8]}"
        cols = [c.split()[0] for c in LAYOUT[name].split(", ")]
        kinds = dict(c.split() for c in LAYOUT[name].split(", "))
        have = {c for c in rows.columns}
        rows = rows.select(*((F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in cols))
        rows = rows.withColumn("_bucket", self._bucket(F.col(KEYS[name])))
        ident = {"chunks": "chunk_id", "files": "path"}[name]  # one path may hold a third of all chunks: several tasks a bucket
        rows.repartition(F.col("_bucket"), F.pmod(F.xxhash64(ident), F.lit(WRITERS))).write.partitionBy("_bucket").parquet(folder)
        for b in touched:
            manifest[name].pop(str(b), None)
        for status in self._fs.listStatus(self._path(folder)):
            part = status.getPath().getName()
            if part.startswith("_bucket="):
                b = part.split("=")[1]
                manifest[name][b] = [*manifest[name].get(b, []), f"{folder}/{part}"]

    def _choose_buckets(self, rows: DataFrame) -> None:
        """At the first write: as many buckets as the rows ask for."""
        manifest = self._read_manifest()
        if not manifest["buckets"]:
            self.buckets = max(MIN_BUCKETS, -(-rows.count() // BUCKET_ROWS))
            self._commit(manifest | {"buckets": self.buckets})

    def _change(self, name: str, keys: DataFrame, key: str, fresh: DataFrame | None, manifest: dict) -> dict:
        """Rows of which ``key`` is among ``keys (_k, _p)`` out, fresh ones in; such rows lie in the buckets of the paths ``_p``."""
        manifest["version"] += 1
        touched = {r.b for r in keys.select(self._bucket(F.col("_p")).alias("b")).distinct().collect()}  # at most `buckets` values
        held = self._scan(name, touched).select(key, self._bucket(F.col(KEYS[name])).alias("_b")).join(keys, F.col(key) == F.col("_k"), "left_semi")
        rewrite = {r["_b"] for r in held.select("_b").distinct().collect()}
        rewrite |= {int(b) for b, folders in manifest[name].items() if len(folders) >= MAX_FOLDERS}
        if rewrite:
            kept = self._scan(name, rewrite).join(keys, F.col(key) == F.col("_k"), "left_anti")
            fresh = kept if fresh is None else kept.unionByName(fresh, allowMissingColumns=True)
        if fresh is not None:
            self._write(name, fresh, rewrite, manifest)
        return manifest

    def rebucket(self, buckets: int) -> None:
        """Spread all rows over another number of buckets."""
        rows = {n: self.read(n) for n in KEYS}
        manifest = self._read_manifest() | {"buckets": buckets, "fulltext": {}}
        manifest["version"] += 1
        self.buckets = buckets
        for n in KEYS:
            manifest[n] = {}
            self._write(n, rows[n], set(), manifest)
        self._commit(manifest)

    def upsert_chunks(self, rows: DataFrame) -> int:
        """Insert chunks, replacing those of the same id; returns how many distinct ids came. No rows, no change."""
        rows = rows.where(F.col("chunk_id").isNotNull() & F.col("file_path").isNotNull()).dropDuplicates(["chunk_id"])
        if rows.isEmpty():
            return 0
        self._choose_buckets(rows)
        manifest = self._read_manifest()
        self._commit(self._change("chunks", rows.select(F.col("chunk_id").alias("_k"), F.col("file_path").alias("_p")), "chunk_id", rows, manifest))
        return rows.count()

    def upsert_files(self, rows: DataFrame) -> None:
        """Insert file records, replacing those of the same path; chunks stay as they are."""
        rows = rows.where(F.col("path").isNotNull()).dropDuplicates(["path"])
        if rows.isEmpty():
            return
        self._choose_buckets(rows)
        manifest = self._read_manifest()
        self._commit(self._change("files", rows.select(F.col("path").alias("_k"), F.col("path").alias("_p")), "path", rows, manifest))

    def replace_files(self, paths: DataFrame, chunks: DataFrame | None, files: DataFrame | None) -> None:
        """In one commit: everything of the paths out, the given chunks and records in."""
        if chunks is not None:
            self._choose_buckets(chunks)
        manifest = self._read_manifest()
        paths = paths.select(F.col(paths.columns[0]).alias("_k")).where(F.col("_k").isNotNull()).distinct().withColumn("_p", F.col("_k"))
        for name, fresh in (("chunks", chunks), ("files", files)):
            manifest = self._change(name, paths, KEYS[name], fresh, manifest)
        self._commit(manifest)

    def delete(self, path: str) -> int:
        """Remove a file and its chunks; returns how many chunks there were."""
        n = self.chunks_of(path).count()
        self.replace_files(self.spark.createDataFrame([(path,)], "p string"), None, None)
        return n

    def rename(self, old: str, new: str) -> int:
        """Give a file another path, vectors and record included; returns how many chunks it has, 0 if there are none."""
        chunks, record = self.chunks_of(old).withColumn("file_path", F.lit(new)), self.file(old).withColumn("path", F.lit(new))
        n = chunks.count()
        if n or not record.isEmpty():
            self.replace_files(self.spark.createDataFrame([(old,), (new,)], "p string"), chunks, record)
        return n

    def stats(self) -> DataFrame:
        """One row: chunks, files, bytes on disk and the time."""
        c, f = self.read("chunks").agg(F.count("*").alias("chunks")), self.read("files").agg(F.count("*").alias("files"))
        size = sum(self._fs.getContentSummary(self._path(p)).getLength() for n in KEYS for ps in self._read_manifest()[n].values() for p in ps)
        return c.crossJoin(f).withColumn("bytes", F.lit(size).cast("long")).withColumn("at", F.current_timestamp())  # one row each

    def fulltext(self) -> StoredIndex:
        """The full-text index of the chunks, brought up to date: postings are kept per bucket, and only those of changed buckets are built again."""
        manifest = self._read_manifest()
        kept, now = manifest.get("fulltext", {}), manifest["chunks"]
        fresh = {b: kept[b] for b in now if b in kept and kept[b]["of"] == now[b]}
        for b in sorted(set(now) - set(fresh)):
            folder = f"{self.root}/fulltext-{manifest['version']}-{uuid.uuid4().hex[:8]}/_bucket={b}"
            rows = self.spark.read.schema(LAYOUT["chunks"]).parquet(*now[b]).select("chunk_id", "content")
            built = StoredIndex.build(rows, "chunk_id", "content", folder, self.buckets)
            fresh[b] = {"of": now[b], "path": folder, "documents": built.documents, "words": built.words}
        if fresh != kept:
            manifest["fulltext"] = fresh
            self._commit(manifest)
        some = [f for f in fresh.values() if f["documents"]]
        return StoredIndex(self.spark, [f["path"] for f in some], sum(f["documents"] for f in some), sum(f["words"] for f in some), self.buckets)

    def vacuum(self) -> int:
        """Remove folders that the manifest no longer names; returns how many."""
        manifest = self._read_manifest()
        used = {p.rsplit("/", 1)[0].rsplit("/", 1)[1] for n in KEYS for ps in manifest[n].values() for p in ps}
        used |= {f["path"].rsplit("/", 2)[1] for f in manifest.get("fulltext", {}).values()}
        n = 0
        for status in self._fs.listStatus(self._path(self.root)):
            if status.isDirectory() and status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
                n += 1
        return n


class MemoryStore:
    """The same contract on rows held by the driver, for tests and small collections; nothing is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {n: {} for n in KEYS}

    def _keep(self, name: str, key: str, rows: DataFrame) -> int:
        rows = rows.where(F.col(key).isNotNull() & F.col(KEYS[name]).isNotNull()).dropDuplicates([key])
        kinds = dict(c.split() for c in LAYOUT[name].split(", "))
        got = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items())).collect()
        self.held[name].update({r[key]: tuple(r) for r in got})
        return len(got)

    def read(self, name: str) -> DataFrame:
        return self.spark.createDataFrame(list(self.held[name].values()), LAYOUT[name])

    def chunks_of(self, path: str) -> DataFrame:
        return self.read("chunks").where(F.col("file_path") == path)

    def file(self, path: str) -> DataFrame:
        return self.read("files").where(F.col("path") == path)

    def upsert_chunks(self, rows: DataFrame) -> int:
        return self._keep("chunks", "chunk_id", rows)

    def upsert_files(self, rows: DataFrame) -> None:
        self._keep("files", "path", rows)

    def replace_files(self, paths: DataFrame, chunks: DataFrame | None, files: DataFrame | None) -> None:
        gone = {r[0] for r in paths.collect()}
        for name, key, fresh in (("chunks", "chunk_id", chunks), ("files", "path", files)):
            rows = None if fresh is None else self.spark.createDataFrame(fresh.collect(), fresh.schema)  # may read this store
            at = [c.split()[0] for c in LAYOUT[name].split(", ")].index(KEYS[name])
            self.held[name] = {k: r for k, r in self.held[name].items() if r[at] not in gone}
            if rows is not None:
                self._keep(name, key, rows)

    def delete(self, path: str) -> int:
        n = self.chunks_of(path).count()
        self.replace_files(self.spark.createDataFrame([(path,)], "p string"), None, None)
        return n

    def rename(self, old: str, new: str) -> int:
        chunks, record = self.chunks_of(old).withColumn("file_path", F.lit(new)), self.file(old).withColumn("path", F.lit(new))
        n = chunks.count()
        if n or not record.isEmpty():
            self.replace_files(self.spark.createDataFrame([(old,), (new,)], "p string"), chunks, record)
        return n

    def stats(self) -> DataFrame:
        row = (len(self.held["chunks"]), len(self.held["files"]), 0)
        return self.spark.createDataFrame([row], "chunks long, files long, bytes long").withColumn("at", F.current_timestamp())

    def fulltext(self) -> None:
        """No index: texts are scanned."""


def list_indexes(spark: SparkSession, home: str) -> DataFrame:
    """``(name, bytes, modified_at)`` of the stores that lie directly below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for s in fs.listStatus(path(home)) if fs.exists(path(home)) else []:
        current = path(f"{home.rstrip('/')}/{s.getPath().getName()}/CURRENT")
        if s.isDirectory() and fs.exists(current):
            rows.append((s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength(), fs.getFileStatus(current).getModificationTime() / 1000))
    return spark.createDataFrame(rows, "name string, bytes long, t double").select("name", "bytes", F.timestamp_seconds("t").alias("modified_at"))


# ---------------------------------------------------------------- the same changes on any two DataFrames


def upsert(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``existing`` with rows of the same key replaced; the given rows must have one row per key."""
    return existing.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def without_path(df: DataFrame, path: str, key: str = "file_path") -> DataFrame:
    return df.where(~F.col(key).eqNullSafe(F.lit(path)))


def renamed(df: DataFrame, old: str, new: str, key: str = "file_path") -> DataFrame:
    return df.withColumn(key, F.when(F.col(key) == old, F.lit(new)).otherwise(F.col(key)))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One whole row per key: the one with the largest values of the order columns."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*(F.col(c) for c in order))).alias("_r"))
    return picked.select(key, *(F.col(f"_r.`{c}`").alias(c) for c in rest)).select(*df.columns)


def with_vectors(chunks: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """Chunks whose missing vectors are zeros; a vector of another length is an error."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    v = F.col(vec_col)
    checked = F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.lit(f"a vector has not {dim} entries")).cast("array<float>"))
    return chunks.withColumn(vec_col, F.when(v.isNull(), zero).otherwise(checked))


def normalized_status(status) -> F.Column:
    """A known status, unknown ones and null as ``pending``."""
    return F.when(status.isin(*schema.STATUSES), status).otherwise("pending")


def normalized_content_type(tag) -> F.Column:
    """Content type tags with pages written as ``pdf:<n>``; null and empty as ``text``."""
    return F.when(tag.isNull() | (tag == ""), "text").otherwise(F.regexp_replace(tag, r"^pdf_page:", "pdf:"))
