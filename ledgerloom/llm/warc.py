"""WARC records of web pages and a Merkle audit of their replicas.

Pages become WARC records in files of a fixed range of page ids.  A leaf is
the hash of a slot's records, each with the range of offsets it fills; an
inner node hashes its children in order with theirs.  Two replicas are
compared from the root down: only the children of nodes whose hashes differ
are read, so an intact replica costs one comparison and a damaged one a path
per damage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, plain, sized_join, table

#: Page ids in a file, and children of a node.
FILE_IDS, FANOUT = 4096, 64
#: The files of pages without an id, away from all others.
NO_ID_FILE, NO_ID_FILES = -(1 << 40), 1 << 20
#: Records of one slot that are hashed at once: there may be any number.
CHUNK = 4096
#: So many parents are named in the filter on a level; beyond, it is joined.
NAMED_PARENTS = 4096


def _null(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``file, slot, page_id, seq, record, offset, length``: the WARC records.

    A file holds ``FILE_IDS`` consecutive ids in ascending order; ``offset`` is
    the record's first byte in its file and ``hash`` that of its bytes.  Pages
    that share an id are ordered by it.  A null url or body counts as empty.
    Pages without an id are spread by their url over ``NO_ID_FILES`` files from
    ``NO_ID_FILE`` on.  Repeated rows are records of their own.  Other columns
    are ignored, whatever their names; an empty table has no records.
    """
    safe, (i, u, h) = plain(pages, id_col, url_col, html_col)
    rows = safe.select(F.col(i).cast("long").alias("page_id"), F.col(u).cast("string").alias("url"), F.col(h).cast("string").alias("html"))
    by_url = F.xxhash64(_null("url"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        _null("url"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(_null("html")).cast("string"),
        F.lit("\r\n\r\n"),
    )
    made = rows.select(
        F.coalesce(F.floor(F.col("page_id") / F.lit(FILE_IDS)), NO_ID_FILE + F.pmod(by_url, F.lit(NO_ID_FILES))).cast("long").alias("file"),
        F.coalesce(F.pmod("page_id", F.lit(FILE_IDS)), F.pmod(F.shiftrightunsigned(by_url, 20), F.lit(FILE_IDS))).cast("int").alias("slot"),
        "page_id",
        F.concat(head, _null("html"), F.lit("\r\n\r\n")).alias("record"),
    ).withColumn("length", F.octet_length("record").cast("long"))
    order = Window.partitionBy("file").orderBy("slot", "hash")
    made = made.withColumn("hash", F.sha2("record", 256))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("seq", (F.row_number().over(Window.partitionBy("file", "slot").orderBy("hash")) - 1).cast("int")).select("file", "slot", "page_id", "seq", "record", "hash", "offset", "length")


@dataclass
class MerkleTree:
    """``levels[0]`` are the leaves (file, slot); the last level is the root.

    Every level has ``node, parent, hash, begin, end, records``, the leaves
    also ``content``, the hash of their records wherever they lie.  Nodes of
    files are numbered file * FILE_IDS + slot at the leaves, so a lost record
    doesn't shift its neighbours.  The leaves are stored in the order of their
    nodes, so that those below a parent are read without the others.
    """

    levels: list[DataFrame]

    @property
    def root(self) -> str | None:
        """None for an archive without records."""
        row = self.levels[-1].select("hash").first()
        return row[0] if row else None


def _parent(node: Column) -> Column:
    return F.floor(node / FANOUT).cast("long").alias("parent")


def _digest(items: Column, *fields: str) -> Column:
    """The hash of a list of structs, of these fields of each in their order."""
    return F.sha2(F.array_join(F.transform(items, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ","), 256)


def _leaves(recs: DataFrame) -> DataFrame:
    """One row per slot; the many records of a slot are hashed in chunks."""
    node = F.col("file") * FILE_IDS + F.col("slot")
    end = (F.col("offset") + F.col("length")).alias("end")
    rows = recs.select(node.alias("node"), F.floor(F.col("seq") / CHUNK).alias("chunk"), "hash", F.col("offset").alias("begin"), end)
    chunks = rows.groupBy("node", "chunk").agg(F.sort_array(F.collect_list(F.struct("hash", "begin", "end"))).alias("x"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("records"))
    hashed = chunks.select("node", "chunk", _digest(F.col("x"), "hash", "begin", "end").alias("hash"), _digest(F.col("x"), "hash").alias("content"), "begin", "end", "records")
    every = F.sort_array(F.collect_list(F.struct("chunk", "hash", "content")))
    whole = hashed.groupBy("node").agg(every.alias("x"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("records").alias("records"))
    return whole.select("node", _parent(F.col("node")), _digest(F.col("x"), "hash").alias("hash"), _digest(F.col("x"), "content").alias("content"), "begin", "end", "records")


def _up(children: DataFrame) -> DataFrame:
    every = F.sort_array(F.collect_list(F.struct("node", "hash", "begin", "end")))
    above = children.groupBy("parent").agg(every.alias("x"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("records").alias("records"))
    return above.select(F.col("parent").alias("node"), _parent(F.col("parent")), _digest(F.col("x"), "node", "hash", "begin", "end").alias("hash"), "begin", "end", "records")


def merkle(recs: DataFrame, height: int | None = None) -> MerkleTree:
    """The tree of ``records(...)``.  Each level is written to the shared
    folder and is a ``FANOUT``th of the one below, up to a single root.
    ``height`` gives trees of two replicas the same number of levels."""

    levels = [table(_leaves(recs).repartitionByRange("node").sortWithinPartitions("node"), "merkle-0")]
    while True:
        # the top must be one node, which all ids, negative ones too, reach
        # under -1 or 0 at last; these two are put under one root
        ends = levels[-1].agg(F.min("node"), F.max("node")).first()
        done = ends[0] is None or (ends[0] >= -1 and ends[1] <= 0)
        if done and (height is None or len(levels) >= height - 1):
            levels[-1] = levels[-1].withColumn("parent", F.lit(0).cast("long"))
            levels.append(table(_up(levels[-1]), f"merkle-{len(levels)}"))
            return MerkleTree(levels)
        levels.append(table(_up(levels[-1]), f"merkle-{len(levels)}"))


def pair(a: DataFrame, b: DataFrame) -> tuple[MerkleTree, MerkleTree]:
    """Trees of two replicas' records with the same number of levels."""
    one, two = merkle(a), merkle(b)
    if len(one.levels) < len(two.levels):
        one = merkle(a, len(two.levels))
    elif len(two.levels) < len(one.levels):
        two = merkle(b, len(one.levels))
    return one, two


def _among(level: DataFrame, column: str, wanted: DataFrame, count: int) -> DataFrame:
    """The rows whose ``column`` is a node of ``wanted``.  A bounded number of
    them is named in a filter, which the stored order lets skip the rest."""
    if count <= NAMED_PARENTS:
        return level.where(F.col(column).isin([r[0] for r in wanted.select("node").collect()]))
    return sized_join(level, wanted.select(F.col("node").alias(column)), [column], "left_semi", 8)


def differing_leaves(a: MerkleTree, b: MerkleTree) -> DataFrame:
    """``node`` of each leaf whose hash differs or that one replica lacks.

    From the root down, the nodes of a level are read only below parents that
    differ.
    """
    bad: DataFrame | None = None
    for mine, other in zip(reversed(a.levels), reversed(b.levels)):
        x, y = mine.select("node", "parent", "hash"), other.select("node", "parent", "hash")
        if bad is not None:
            x, y = (_among(t, "parent", bad, count) for t in (x, y))
        x, y = x.select("node", F.col("hash").alias("ha")), y.select("node", F.col("hash").alias("hb"))
        bad = cut(x.join(y, "node", "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("node"))
        count = bad.count()
        if not count:
            return bad
    return bad


def audit_trees(a: MerkleTree, b: MerkleTree) -> DataFrame:
    """``audit`` of trees that exist already, with equally many levels."""
    bad = differing_leaves(a, b)
    count = bad.count()
    x = _among(a.levels[0], "node", bad, count).select("node", F.col("records").alias("na"), F.col("content").alias("ca"), F.col("begin").alias("ba"), F.col("end").alias("ea"))
    y = _among(b.levels[0], "node", bad, count).select("node", F.col("records").alias("nb"), F.col("content").alias("cb"), F.col("begin").alias("bb"), F.col("end").alias("eb"))
    both = x.join(y, "node", "full_outer")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    damage = F.when(nb < na, "missing").when(nb > na, "extra").when(F.col("ca") == F.col("cb"), "moved").otherwise("altered")
    file = F.floor(F.col("node") / FILE_IDS).cast("long")
    has_id = (file < NO_ID_FILE) | (file >= NO_ID_FILE + NO_ID_FILES)
    return both.select(file.alias("file"), F.when(has_id, F.col("node")).alias("page_id"), damage.alias("damage"), F.coalesce("ba", "bb").alias("begin"), F.coalesce("ea", "eb").alias("end"))


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """``file, page_id, damage, begin, end``: where the replica is corrupt.

    Both are ``records(...)``, the replica's with the offsets at which its
    records were found.  ``damage`` is ``missing`` (the replica lacks records
    of that id), ``extra`` (it has more than the original), ``moved`` (the same
    records at other offsets) or ``altered``; ``begin`` and ``end`` are the
    offsets in the original's file, or in the replica's where the original has
    none.  ``page_id`` is null for pages without an id.  Records that repeat
    count each.  Empty against empty, or equal roots, give an empty result.
    """
    return audit_trees(*pair(original, replica))
