"""A versioned record store on Parquet with optimistic concurrency.

Each version is one commit file ``log/<n>.json``, created only if absent, that
names the folder of every (namespace, collection) as of that version.  A
writer evaluates its batch against a version, writes anew the collections it
changes and no others, and tries to create the commit file; if another was
first it starts again on what is now current, so a stale expectation is
reported as a conflict and never overwrites.  Readers pin a version and are
not disturbed.  ``vacuum`` removes what no kept version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY, content_hash, is_blob_hash, matches

RECORD = (
    "namespace string, collection string, id string, kind string, "
    "revision struct<counter: bigint, hash: string>, parent struct<counter: bigint, hash: string>, "
    "body struct<inline: binary, blob_hash: string, blob_len: bigint>, "
    "meta struct<author: struct<id: string, display: string>, origin_system: string, created: bigint, updated: bigint, labels: map<string, string>>, "
    "links array<struct<namespace: string, collection: string, id: string>>"
)
#: File systems whose create-if-absent is atomic, and those that can be asked
#: for a conditional write.
ATOMIC_SCHEMES, CONDITIONAL_SCHEMES = ("hdfs", "viewfs", "abfs", "abfss", "gs"), ("s3a",)
CONDITIONAL_WRITE = "fs.option.create.conditional.overwrite"
MAX_ATTEMPTS = 16
MAX_BLOB = 64 << 20


class NotFound(Exception):
    """A put expects a revision of a record that doesn't exist."""


class Rejected(Exception):
    """The other store's history isn't the beginning of this one's."""


class Raced(Exception):
    """Others committed first, too many times in a row."""


class Files:
    """The few file operations of the log, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def create(self, path: str, text: str) -> bool:
        """Whether the file was created; False if it was there already.

        On a file system of this machine a hard link decides, since its
        create call isn't atomic.  HDFS and the like create atomically; an
        object store is asked for a conditional write and, if it doesn't know
        any, is refused, as two writers could both win there.
        """
        fs, p = self._at(path)
        scheme = fs.getScheme()
        if scheme == "file":
            import os

            to = p.toUri().getPath()
            os.makedirs(os.path.dirname(to), exist_ok=True)
            temporary = f"{to}.{uuid.uuid4().hex}"
            with open(temporary, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temporary, to)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temporary)
        if scheme in ATOMIC_SCHEMES:
            build = lambda: fs.create(p, False)
        elif scheme in CONDITIONAL_SCHEMES:
            build = lambda: fs.createFile(p).overwrite(False).must(CONDITIONAL_WRITE, True).build()
        else:
            raise ValueError(f"{scheme}: files can't be created conditionally")
        try:
            out = build()
            out.write(bytearray(text.encode()))
            out.close()  # where a conditional write is decided
        except Exception as e:
            if fs.exists(p) and self.read(path) != text:
                return False
            raise e
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text


def outcomes(current: DataFrame, puts: DataFrame) -> DataFrame:
    """Evaluate conditional puts: ``puts`` have the record's columns and
    ``expected`` (a revision, or null for a record that must not exist);
    ``arrival`` orders puts of one key, of which the first that fits wins.

    Adds ``outcome``: ``committed``, ``conflict`` or ``not_found``, and
    ``current``: the revision that was in the way.
    """
    now = current.select(*KEY, F.col("revision").alias("current"))
    order = Window.partitionBy(*KEY, "outcome").orderBy("arrival")
    judged = puts.join(now, list(KEY), "left")
    same = F.col("expected").eqNullSafe(F.col("current"))
    outcome = F.when(same, "committed").when(F.col("current").isNull(), "not_found").otherwise("conflict")
    judged = judged.withColumn("outcome", outcome).withColumn("n", F.row_number().over(order))
    late = (F.col("outcome") == "committed") & (F.col("n") > 1)
    return judged.withColumn("outcome", F.when(late, "conflict").otherwise(F.col("outcome"))).drop("n")


def delete_outcomes(current: DataFrame, deletes: DataFrame) -> DataFrame:
    """Evaluate conditional deletes: keys with ``expected``, null for any.  An
    absent record counts as deleted whatever was expected."""
    now = current.select(*KEY, F.col("revision").alias("current"))
    fits = F.col("current").isNull() | F.col("expected").isNull() | F.col("expected").eqNullSafe(F.col("current"))
    return deletes.join(now, list(KEY), "left").withColumn("outcome", F.when(fits, "deleted").otherwise("conflict"))


class RecordStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._files = spark, root.rstrip("/"), Files(spark)

    # versions
    def version(self) -> int:
        """The current version; 0 before the first commit."""
        found = [int(n[:-5]) for n in self._files.names(f"{self.root}/log") if n.endswith(".json") and n[:-5].isdigit()]
        return max(found, default=0)

    def _entry(self, version: int) -> dict:
        return json.loads(self._files.read(f"{self.root}/log/{version:020d}.json"))

    def history(self) -> list[dict]:
        return [{"version": v, **self._entry(v)} for v in range(1, self.version() + 1)]

    def records(self, version: int | None = None) -> DataFrame:
        """All records of a version, by default the current one."""
        return self._read(self.version() if version is None else version)

    def _read(self, version: int, wanted: set[str] | None = None) -> DataFrame:
        """The records of a version, of the ``wanted`` parts only if given."""
        parts = self._entry(version)["parts"] if version else {}
        paths = sorted(p["path"] for name, p in parts.items() if wanted is None or name in wanted)
        return self.spark.read.schema(RECORD).parquet(*paths) if paths else self.spark.createDataFrame([], RECORD)

    @staticmethod
    def _part() -> Column:
        """The name of the part that a record's collection is."""
        return F.substring(F.sha2(F.to_json(F.struct("namespace", "collection")), 256), 1, 32)

    def _parts_of(self, rows: DataFrame) -> dict[str, tuple[str, str]]:
        """The parts of some rows: as many as they have collections."""
        return {r[0]: (r[1], r[2]) for r in rows.select(self._part().alias("part"), "namespace", "collection").distinct().collect()}

    def _commit(self, base: int, after: DataFrame, touched: dict[str, tuple[str, str]] | None, note: str, author: str | None = None, message: str | None = None) -> bool:
        """Publish ``after`` as the records of the parts ``touched``, or of all
        if that is None, on top of version ``base``."""
        data = f"{self.root}/data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], RECORD).columns
        after.select(*columns, self._part().alias("part")).write.partitionBy("part").parquet(data)
        before = self._entry(base)["parts"] if base and touched is not None else {}
        parts = {name: p for name, p in before.items() if name not in (touched or {})}
        names = touched if touched is not None else self._parts_of(after)
        for folder in self._files.names(data):
            if folder.startswith("part="):
                namespace, collection = names[folder[5:]]
                parts[folder[5:]] = {"namespace": namespace, "collection": collection, "path": f"{data}/{folder}"}
        entry = {"id": uuid.uuid4().hex, "parts": parts, "note": note, "author": author, "message": message, "changed": sorted(names)}
        if self._files.create(f"{self.root}/log/{base + 1:020d}.json", json.dumps(entry)):
            return True
        self._files.delete(data)
        return False

    def vacuum(self, keep: int = 1) -> int:
        """Remove the data that the last ``keep`` versions don't name and all
        pending batches; how many folders.  Older versions stay in the history
        but can't be read.  Not to be run while others write."""
        now = self.version()
        named = {p["path"].rsplit("/", 2)[-2] + "/" + p["path"].rsplit("/", 1)[-1] for v in range(max(1, now - keep + 1), now + 1) for p in self._entry(v)["parts"].values()}
        gone = 0
        for folder in self._files.names(f"{self.root}/data"):
            inside = [x for x in self._files.names(f"{self.root}/data/{folder}") if x.startswith("part=")]
            dead = [x for x in inside if f"{folder}/{x}" not in named]
            for path in [f"{self.root}/data/{folder}"] if len(dead) == len(inside) else [f"{self.root}/data/{folder}/{x}" for x in dead]:
                self._files.delete(path)
                gone += 1
        self._files.delete(f"{self.root}/pending")
        return gone

    # histories of two stores
    def contains(self, other: RecordStore) -> bool:
        """Whether the other's history is the beginning of this one's."""
        n = other.version()
        return n == 0 or (n <= self.version() and self._entry(n)["id"] == other._entry(n)["id"])

    def pull(self, other: RecordStore) -> dict:
        """Advance to the other's version if that only adds to this history.

        ``fast_forwarded`` is false if there was nothing to take; histories
        that have parted are ``Rejected``, to be merged by ``sync.three_way``.
        """
        if self.contains(other):
            return {"fast_forwarded": False, "version": self.version()}
        if not other.contains(self):
            raise Rejected(f"{self.root} and {other.root} have parted")
        moved: dict[str, str] = {}
        for v in range(self.version() + 1, other.version() + 1):
            entry = other._entry(v)
            for p in entry["parts"].values():
                if p["path"].startswith(f"{self.root}/"):
                    continue
                if p["path"] not in moved:
                    moved[p["path"]] = f"{self.root}/data/{'/'.join(p['path'].rsplit('/', 2)[-2:])}"
                    if not self._files.names(moved[p["path"]]):
                        self.spark.read.schema(RECORD).parquet(p["path"]).write.mode("overwrite").parquet(moved[p["path"]])
                p["path"] = moved[p["path"]]
            if not self._files.create(f"{self.root}/log/{v:020d}.json", json.dumps(entry)):
                raise Raced(f"another wrote version {v} meanwhile")
        return {"fast_forwarded": True, "version": self.version()}

    def push(self, other: RecordStore) -> dict:
        """Advance the other to this version; ``Rejected`` unless this history
        goes on from the other's."""
        if not self.contains(other):
            raise Rejected(f"{other.root} has what {self.root} lacks")
        return other.pull(self)

    # reads
    def get(self, namespace: str, collection: str, id: str) -> DataFrame:
        return self.list(namespace, collection).where(F.col("id") == id)

    def list(self, namespace: str | None = None, collection: str | None = None) -> DataFrame:
        """The records of a prefix; other collections' files aren't opened."""
        version = self.version()
        parts = self._entry(version)["parts"] if version else {}
        wanted = {n for n, p in parts.items() if namespace in (None, p["namespace"]) and collection in (None, p["collection"])}
        return self._read(version, wanted).where(matches(namespace, collection))

    def status(self) -> DataFrame:
        return self.records().groupBy("namespace", "collection").agg(F.count("*").alias("n"))

    # writes
    def put(self, puts: DataFrame, retain: bool = False, author: str | None = None, message: str | None = None) -> DataFrame:
        """Commit a batch; its outcomes as ``outcomes`` gives them.  A put that
        expects a revision of an absent record fails the whole batch.  With
        ``retain`` committed bodies are kept as the ancestry of later merges.
        Only the collections of committed puts are written."""
        puts = puts if "arrival" in puts.columns else puts.withColumn("arrival", F.monotonically_increasing_id())
        puts = self._stored(puts)
        asked = set(self._parts_of(puts))
        for _ in range(MAX_ATTEMPTS):
            base = self.version()
            judged = self._stored(outcomes(self._read(base, asked), puts))
            lost = judged.where(F.col("outcome") == "not_found").select(*KEY).first()
            if lost:
                raise NotFound("/".join(lost))
            good = judged.where(F.col("outcome") == "committed")
            touched = self._parts_of(good)
            if not touched:
                return judged
            current = self._read(base, set(touched))
            after = current.join(good.select(*KEY), list(KEY), "left_anti").unionByName(good.select(*current.columns))
            if self._commit(base, after, touched, "put", author, message):
                if retain:
                    self.put_blobs(good.where(F.col("body.inline").isNotNull()).select(F.col("revision.hash").alias("hash"), F.col("body.inline").alias("content")))
                return judged
        raise Raced(f"no commit in {MAX_ATTEMPTS} attempts")

    def delete(self, deletes: DataFrame, author: str | None = None, message: str | None = None) -> DataFrame:
        """Commit a batch of deletes; their outcomes.  Nothing is written if
        none of the records is there."""
        deletes = self._stored(deletes)
        asked = set(self._parts_of(deletes))
        for _ in range(MAX_ATTEMPTS):
            base = self.version()
            judged = self._stored(delete_outcomes(self._read(base, asked), deletes))
            good = judged.where((F.col("outcome") == "deleted") & F.col("current").isNotNull()).select(*KEY).distinct()
            touched = self._parts_of(good)
            if not touched or self._commit(base, self._read(base, set(touched)).join(good, list(KEY), "left_anti"), touched, "delete", author, message):
                return judged
        raise Raced(f"no commit in {MAX_ATTEMPTS} attempts")

    def replace(self, base: int, after: DataFrame, note: str) -> bool:
        """Publish a whole new version if ``base`` is still current."""
        return self._commit(base, after, None, note)

    def _stored(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/pending/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # blobs
    def blobs(self) -> DataFrame:
        """``hash, content, len``, one row per hash."""
        parts = self._files.names(f"{self.root}/blobs")
        schema = "hash string, content binary, len bigint"
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/blobs/{p}" for p in sorted(parts)])
        return rows.where(is_blob_hash("hash")).dropDuplicates(["hash"])

    def put_blobs(self, contents: DataFrame) -> None:
        """Append contents whose hash isn't there.  A hash that is given and
        wrong, or a content over the limit, is an error."""
        given = F.col("hash") if "hash" in contents.columns else content_hash("content")
        checked = F.when((content_hash("content") == given) & (F.octet_length("content") <= MAX_BLOB), given).otherwise(F.raise_error("blob hash mismatch or blob too large"))
        rows = contents.select(checked.alias("hash"), F.col("content").cast("binary").alias("content"), F.octet_length("content").cast("long").alias("len"))
        known = self.blobs().select("hash")
        rows.dropDuplicates(["hash"]).join(known, "hash", "left_anti").write.parquet(f"{self.root}/blobs/{uuid.uuid4().hex}")

    def list_blobs(self) -> DataFrame:
        """``hash, len`` of every blob; contents aren't read."""
        return self.blobs().select("hash", "len")

    def delete_blobs(self, hashes: DataFrame) -> int:
        """Remove blobs by hash; how many there were.  Only the batches that
        hold one of them are written anew.  Not to be run beside ``put_blobs``."""
        parts = sorted(self._files.names(f"{self.root}/blobs"))
        gone = hashes.select("hash").distinct()
        removed = 0
        for part in parts:
            path = f"{self.root}/blobs/{part}"
            rows = self.spark.read.schema("hash string, content binary, len bigint").parquet(path)
            dead = rows.select("hash").join(gone, "hash", "left_semi").count()
            if dead:
                kept = rows.join(gone, "hash", "left_anti")
                if not kept.isEmpty():
                    kept.write.parquet(f"{self.root}/blobs/{uuid.uuid4().hex}")
                self._files.delete(path)
                removed += dead
        return removed

    def collect_garbage(self) -> DataFrame:
        """Delete the blobs that no manifest of any view holds, nor any record
        by reference; one row, ``freed, retained``."""
        from .manifest import from_body, gc_report

        records = self.records()
        bodies = records.where("kind = 'graph_manifest'").select(F.col("namespace").alias("repo"), F.col("id").alias("view_id"), F.col("body.inline").cast("string").alias("body"))
        referred = records.where(F.col("body.blob_hash").isNotNull()).select(F.col("body.blob_hash").alias("hash"))
        ancestry = records.where(F.col("parent.hash").isNotNull()).select(F.col("parent.hash").alias("hash")).union(records.select(F.col("revision.hash").alias("hash")))
        held = self._stored(from_body(bodies).select("hash").union(referred).union(ancestry).distinct())
        blobs = self._stored(self.list_blobs())
        report = self._stored(gc_report(blobs, held))
        self.delete_blobs(blobs.join(held, "hash", "left_anti"))
        return report


def expected_absent() -> Column:
    return F.lit(None).cast("struct<counter: bigint, hash: string>").alias("expected")
