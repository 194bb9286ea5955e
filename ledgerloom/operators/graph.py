"""Code-graph queries over ``symbols`` and ``refs``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_tests, language_of
from ._shared import cut


@dataclass(frozen=True)
class SymbolFilter:
    """Conjunction of what is given."""

    path_prefix: str | None = None
    kind: str | None = None
    name_contains: str | None = None

    def column(self) -> Column:
        out = F.lit(True)
        if self.path_prefix is not None:
            out = out & F.col("path").startswith(self.path_prefix)
        if self.kind is not None:
            out = out & (F.col("kind") == self.kind)
        if self.name_contains is not None:
            out = out & F.contains(F.col("name"), F.lit(self.name_contains))
        return out


@dataclass
class Page:
    """The first ``limit`` items, and lazily how many there are."""

    every: DataFrame
    items: DataFrame
    limit: int

    @property
    def total(self) -> int:
        return self.every.count()

    @property
    def truncated(self) -> bool:
        return self.total > self.limit


def page(ordered: DataFrame, limit: int) -> Page:
    return Page(ordered, ordered.limit(limit), limit)


def symbols_in_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("seq")


def definitions(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name).orderBy("path", "seq")


def references_to(refs: DataFrame, name: str) -> DataFrame:
    return refs.where(F.col("name") == name).orderBy("path", "seq")


def callers(refs: DataFrame, name: str) -> DataFrame:
    found = refs.where((F.col("name") == name) & F.col("from_fn").isNotNull())
    return found.select(F.col("from_fn").alias("name")).distinct().orderBy("name")


def callees(refs: DataFrame, name: str) -> DataFrame:
    return refs.where(F.col("from_fn") == name).select("name").distinct().orderBy("name")


def neighborhood(refs: DataFrame, name: str) -> DataFrame:
    root = refs.sparkSession.range(1).select(F.lit(name).alias("name"))
    return root.union(callers(refs, name)).union(callees(refs, name)).distinct()


def impact(refs: DataFrame, name: str) -> DataFrame:
    """All that call ``name`` directly or through others, without ``name``.

    A breadth-first search.  The frontier is joined with the distinct edges
    and what was seen taken off; lineage is cut once for every ``LEVELS``
    levels, after which an unchanged number of names ends the loop, so cycles
    do no harm.
    """
    edges = cut(refs.where(F.col("from_fn").isNotNull()).select("name", F.col("from_fn").alias("to")).distinct())
    start = refs.sparkSession.createDataFrame([(name, 0)], "name string, level int")
    seen, frontier, level = start, start, 0
    while True:
        found = [seen]
        for _ in range(LEVELS):
            level += 1
            frontier = edges.join(frontier, "name", "left_semi").select(F.col("to").alias("name")).distinct().withColumn("level", F.lit(level))
            found.append(frontier)
        every = found[0]
        for f in found[1:]:
            every = every.union(f)
        # a name counts on the level that it was reached on first
        seen = cut(every.groupBy("name").agg(F.min("level").alias("level")))
        frontier = seen.where(F.col("level") == level)
        if frontier.isEmpty():
            return seen.where(F.col("name") != name).select("name").orderBy("name")


def totals(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: ``symbols, references, files``."""
    counted = symbols.agg(F.count("*").alias("symbols")).crossJoin(refs.agg(F.count("*").alias("references")))
    files = symbols.select("path").union(refs.select("path")).distinct().agg(F.count("*").alias("files"))
    return counted.crossJoin(files)


def by_kind(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


def by_language(symbols: DataFrame) -> DataFrame:
    # languages of the few paths rather than of the many symbols
    counted = symbols.groupBy("path").agg(F.count("*").alias("n"))
    return counted.groupBy(language_of("path").alias("language")).agg(F.sum("n").alias("n"))


def largest_files(symbols: DataFrame, limit: int) -> DataFrame:
    return symbols.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "path").limit(limit)


def overview(symbols: DataFrame, refs: DataFrame, largest: int = 20) -> DataFrame:
    """One row: the totals, ``by_kind`` and ``by_language`` as sorted lists of
    ``name, n``, and the ``largest`` files as ``path, n``.  Kinds, languages
    and files listed are few, so each list is one small aggregate."""

    def listed(df: DataFrame, name: str, order: list) -> DataFrame:
        key = df.columns[0]
        entry = F.struct(*order, F.struct(F.col(key).alias("path" if key == "path" else "name"), "n").alias("x"))
        return df.agg(F.sort_array(F.collect_list(entry)).alias(name)).select(F.col(f"{name}.x").alias(name))

    parts = [
        listed(by_kind(symbols), "by_kind", [F.col("kind").alias("k")]),
        listed(by_language(symbols), "by_language", [F.col("language").alias("k")]),
        listed(largest_files(symbols, largest), "largest", [(-F.col("n")).alias("k"), F.col("path").alias("p")]),
    ]
    out = totals(symbols, refs)
    for p in parts:
        out = out.crossJoin(F.broadcast(p))
    return out


def scores(symbols: DataFrame, refs: DataFrame, ranking: str) -> DataFrame:
    """``name, score``: paths that define a name, references to it, or the
    distinct names it refers to."""
    if ranking == "definitions":
        return symbols.groupBy("name").agg(F.countDistinct("path").alias("score"))
    if ranking == "fan_in":
        return refs.groupBy("name").agg(F.count("*").alias("score"))
    if ranking == "fan_out":
        calls = refs.where(F.col("from_fn").isNotNull())
        return calls.groupBy(F.col("from_fn").alias("name")).agg(F.countDistinct("name").alias("score"))
    raise ValueError(f"unknown ranking {ranking!r}")


def top(symbols: DataFrame, refs: DataFrame, ranking: str, limit: int = 20) -> DataFrame:
    """The best ``limit`` names with the paths that define them.  The paths
    are joined after the limit."""
    best = scores(symbols, refs, ranking).orderBy(F.col("score").desc(), "name").limit(limit)
    paths = symbols.join(F.broadcast(best.select("name")), "name", "left_semi").groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    none = F.array().cast("array<string>")
    return best.join(paths, "name", "left").select("name", "score", F.coalesce("paths", none).alias("paths")).orderBy(F.col("score").desc(), "name")


def list_symbols(symbols: DataFrame, wanted: SymbolFilter = SymbolFilter(), limit: int = 100) -> Page:
    return page(symbols.where(wanted.column()).orderBy("path", "seq"), limit)


def unreferenced(symbols: DataFrame, refs: DataFrame, wanted: SymbolFilter = SymbolFilter(), exclude_tests: bool = True) -> DataFrame:
    """Symbols whose name nothing refers to, by path and line.

    Without tests: neither paths with a ``tests`` folder, nor what lies within
    a module named ``test`` or ``tests`` of the same file, nor such a module.
    """
    found = symbols.where(wanted.column())
    if exclude_tests:
        found = found.where(~in_tests("path"))
        modules = symbols.where((F.col("kind") == "module") & F.col("name").isin("tests", "test")).alias("m")
        s = found.alias("s")
        inside = (F.col("s.path") == F.col("m.path")) & (F.col("s.start_line") >= F.col("m.start_line")) & (F.col("s.end_line") <= F.col("m.end_line"))
        found = s.join(modules, inside, "left_anti")
    named = refs.select("name").distinct()
    return found.join(named, "name", "left_anti").select(*symbols.columns).orderBy("path", "start_line", "seq")


def resolve(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Every reference with ``resolution`` and ``target`` path: ``local`` if
    its own file defines the name, ``unique`` if one file does, ``ambiguous``
    if several do, else ``unresolved``.

    Two small tables of distinct names and of distinct (path, name) are joined
    rather than all definitions, so a hub name meets one row.
    """
    homes = symbols.select("name", "path").distinct()
    named = homes.groupBy("name").agg(F.count("*").alias("homes"), F.min("path").alias("only"))
    own = homes.withColumn("own", F.lit(True))
    joined = refs.join(named, "name", "left").join(own, ["name", "path"], "left")
    kind = F.when(F.col("own"), "local").when(F.col("homes").isNull(), "unresolved").when(F.col("homes") == 1, "unique").otherwise("ambiguous")
    target = F.when(F.col("own"), F.col("path")).when(F.col("homes") == 1, F.col("only"))
    return joined.select(*refs.columns, kind.alias("resolution"), target.alias("target"))


def resolve_references_to(symbols: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    return resolve(symbols.where(F.col("name") == name), refs.where(F.col("name") == name)).orderBy("path", "seq")


def resolved_callers(symbols: DataFrame, refs: DataFrame, path: str, name: str) -> DataFrame:
    hit = resolve_references_to(symbols, refs, name).where((F.col("target") == path) & F.col("from_fn").isNotNull())
    return hit.select(F.col("from_fn").alias("name")).distinct().orderBy("name")


def first_per_key(rows: DataFrame, key: list[str]) -> DataFrame:
    order = Window.partitionBy(*key).orderBy("seq")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


#: Levels of a search between two cuts of its lineage.
LEVELS = 4
SYMBOL_KEY, REF_KEY = ["path", "name", "kind"], ["path", "from_fn", "name"]


def diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """``change`` (``added`` or ``removed``) and the rows of two views whose
    structural key the other lacks, one per key.  Lines may move freely."""

    def lacking(x: DataFrame, y: DataFrame, change: str) -> DataFrame:
        other = y.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return first_per_key(x.join(other, same, "left_anti"), key).withColumn("change", F.lit(change))

    return lacking(b, a, "added").unionByName(lacking(a, b, "removed"))


def replace_paths(rows: DataFrame, new: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``rows`` with those of the given paths (by default the new ones')
    replaced: an insert, or with no new rows a removal."""
    gone = (new if paths is None else paths).select("path").distinct()
    return rows.join(gone, "path", "left_anti").select(*rows.columns).unionByName(new)


_SLICE = "symbols array<struct<name: string, kind: string, start_line: bigint, end_line: bigint>>, references array<struct<name: string, from: string, line: bigint>>"


def assemble(manifest: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, refs) of a manifest's files from their stored slices.  A
    missing blob is passed over, a corrupt one is an error."""
    found = manifest.join(blobs, "hash").select("repo", "view_id", "path", F.from_json(F.col("content").cast("string"), _SLICE, {"mode": "FAILFAST"}).alias("s"))
    place = ["repo", "view_id", "path"]
    symbols = found.select(*place, F.posexplode("s.symbols").alias("seq", "x")).select(*place, "seq", "x.name", "x.kind", "x.start_line", "x.end_line")
    refs = found.select(*place, F.posexplode("s.references").alias("seq", "x")).select(*place, "seq", "x.name", F.col("x.from").alias("from_fn"), "x.line")
    return symbols, refs
