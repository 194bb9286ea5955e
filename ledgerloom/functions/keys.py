"""Keys, content hashes and revisions as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("namespace", "collection", "id")

#: The merge class that each kind of record belongs to.
MERGE_CLASS = {"topic": "append_only", "session": "append_only", "ticket_event": "append_only", "memory_tier": "structured", "ticket": "structured", "checkpoint": "opaque", "graph_manifest": "derived"}


def segment(c: Column | str) -> Column:
    """An injective path segment: everything but ASCII letters, digits, ``_``
    and ``-`` as ``%XX`` of its UTF-8 bytes."""
    out = F.url_encode(c)
    for plain, coded in (("+", "%20"), (".", "%2E"), ("*", "%2A"), ("~", "%7E")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def decode_segment(c: Column | str) -> Column:
    """The inverse of ``segment``; a ``%`` without two hex digits stays."""
    c = F.col(c) if isinstance(c, str) else c
    stray = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(stray)


def object_key(namespace: Column | str = "namespace", collection: Column | str = "collection", id: Column | str = "id") -> Column:
    return F.concat(segment(namespace), F.lit("/"), segment(collection), F.lit("/"), segment(id), F.lit(".json"))


def display(namespace: Column | str = "namespace", collection: Column | str = "collection", id: Column | str = "id") -> Column:
    return F.concat_ws("/", namespace, collection, id)


def matches(namespace: str | None = None, collection: str | None = None) -> Column:
    """A key prefix: what isn't given matches anything."""
    out = F.lit(True)
    if namespace is not None:
        out = out & (F.col("namespace") == namespace)
    if collection is not None:
        out = out & (F.col("collection") == collection)
    return out


def content_hash(c: Column | str) -> Column:
    """64 lower-case hex digits of the SHA-256 of the bytes."""
    return F.sha2(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"), 256)


def is_blob_hash(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(r"\A[0-9a-f]{64}\z")


def parse_object_key(c: Column | str) -> Column:
    """``namespace, collection, id`` of an object key, null if it is none."""
    parts = F.split(c, "/")
    name = F.element_at(parts, 3)
    part = lambda i: decode_segment(F.element_at(parts, i))
    made = F.struct(part(1).alias("namespace"), part(2).alias("collection"), decode_segment(F.regexp_replace(name, r"\.json$", "")).alias("id"))
    return F.when((F.size(parts) == 3) & name.endswith(".json"), made)


def initial_revision(body: Column | str) -> Column:
    return F.struct(F.lit(0).cast("long").alias("counter"), content_hash(body).alias("hash"))


def next_revision(revision: Column, body: Column | str) -> Column:
    return F.struct((revision["counter"] + 1).alias("counter"), content_hash(body).alias("hash"))


def merge_class(kind: Column | str) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.element_at(F.create_map(*[F.lit(x) for pair in MERGE_CLASS.items() for x in pair]), kind)


#: Namespaces that only their own operations write.
RESERVED = ("_blobs", "tickets")


def view_folder(repo: Column | str, view_id: Column | str) -> Column:
    """The relative folder of a stored view; no two views share one."""
    return F.concat(segment(repo), F.lit("/"), segment(view_id), F.lit(".db"))


@dataclass(frozen=True)
class Principal:
    """Who asks: the namespaces that may be read and written, ``*`` for all."""

    name: str = "local"
    read: tuple[str, ...] = ("*",)
    write: tuple[str, ...] = ("*",)
    authenticated: bool = True

    def may(self, access: str, namespace: str) -> bool:
        scopes = self.read if access == "read" else self.write
        return "*" in scopes or namespace in scopes

    def readable(self, rows: DataFrame) -> DataFrame:
        """The rows of namespaces that the principal may read."""
        return rows if "*" in self.read else rows.where(F.col("namespace").isin(list(self.read)))

    def check_write(self, rows: DataFrame) -> None:
        """``PermissionError`` for the first namespace that may not be written;
        reserved ones need ``*``."""
        for (namespace,) in rows.select("namespace").distinct().collect():
            if not self.may("write", namespace) or (namespace in RESERVED and "*" not in self.write):
                raise PermissionError(f"{self.name} may not write {namespace}")

    def stamped(self, records: DataFrame) -> DataFrame:
        """Records with this author, if there is one; else as they came."""
        if not self.authenticated:
            return records
        author = F.struct(F.lit(self.name).alias("id"), F.lit(None).cast("string").alias("display"))
        return records.withColumn("meta", F.col("meta").withField("author", author))


def principals(config: str) -> dict[str, Principal]:
    """Principals by token from TOML: ``[[principal]]`` tables with ``name``,
    ``token``, ``read`` and ``write``.  A token may be given once."""
    import tomllib

    found: dict[str, Principal] = {}
    for p in tomllib.loads(config).get("principal", []):
        if p["token"] in found:
            raise ValueError("a token is given twice")
        found[p["token"]] = Principal(p["name"], tuple(p.get("read", ())), tuple(p.get("write", ())))
    return found


def is_probe_path(path: Column | str) -> Column:
    """Health checks, which need no principal."""
    return (F.col(path) if isinstance(path, str) else path).isin("/healthz", "/readyz")


def allows(scopes: Column, namespace: Column | str) -> Column:
    """Whether a principal's scopes admit a namespace; ``*`` admits all."""
    return F.array_contains(scopes, F.col(namespace) if isinstance(namespace, str) else namespace) | F.array_contains(scopes, F.lit("*"))
