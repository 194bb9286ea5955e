"""The tools of the query surface over stored views, by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import allows
from ..operators import graph, manifest


class UnknownView(LookupError):
    pass


def _paged(items: DataFrame, counted: DataFrame, limit: int) -> DataFrame:
    """``items`` with ``total``, of how many they are the first, and whether
    they are ``truncated``.  ``counted`` is one row."""
    return items.crossJoin(F.broadcast(counted)).withColumn("truncated", F.col("total") > limit)


@dataclass
class Service:
    """Tables of all views: ``symbols``, ``refs``, ``manifests``; ``records``
    for ``status``, and ``blobs`` (slices by hash) to assemble views that are
    in the manifests but not among the stored rows."""

    symbols: DataFrame
    refs: DataFrame
    manifests: DataFrame
    records: DataFrame | None = None
    blobs: DataFrame | None = None

    def _view(self, repo: str, view: str) -> tuple[DataFrame, DataFrame]:
        own = (F.col("repo") == repo) & (F.col("view_id") == view)
        s, r = self.symbols.where(own), self.refs.where(own)
        if not (s.isEmpty() and r.isEmpty()):
            return s, r
        listed = self.manifests.where(own)
        if listed.isEmpty():
            some = [f"{v.repo}/{v.view_id}" for v in manifest.views(self.manifests).limit(20).collect()]
            raise UnknownView(f"{repo}/{view} is not indexed; there are: {', '.join(some) or 'none'}")
        return graph.assemble(listed, self.blobs) if self.blobs is not None else (s, r)

    def readable(self, records: DataFrame, scopes: list[str]) -> DataFrame:
        """The records that a principal's namespaces admit."""
        return records.where(allows(F.array(*[F.lit(s) for s in scopes]), "namespace"))

    def dispatch(self, tool: str, repo: str = "", view: str = "", **args) -> DataFrame:
        if tool == "status":
            return self.records.groupBy("namespace", "collection").agg(F.count("*").alias("n"))
        if tool == "views":
            return manifest.views(self.manifests)
        s, r = self._view(repo, view)
        wanted = graph.SymbolFilter(args.get("path_prefix"), args.get("kind"), args.get("name_contains"))
        name, limit = args.get("name", ""), args.get("limit")
        if tool == "search":
            return graph.definitions(s, name)
        if tool == "callers":
            return graph.callers(r, name)
        if tool == "callees":
            return graph.callees(r, name)
        if tool == "impact":
            return graph.impact(r, name)
        if tool == "explore":
            return graph.references_to(r, name)
        if tool == "node":
            parts = {"definition": graph.definitions(s, name).select("path"), "caller": graph.callers(r, name), "callee": graph.callees(r, name)}
            frames = [df.select(F.lit(k).alias("role"), F.col(df.columns[0]).alias("value")) for k, df in parts.items()]
            return frames[0].union(frames[1]).union(frames[2])
        if tool == "diff":
            s2, r2 = self._view(repo, args["other"])
            symbols = graph.diff(s, s2, graph.SYMBOL_KEY).select("change", F.lit("symbol").alias("what"), "path", "name")
            return symbols.union(graph.diff(r, r2, graph.REF_KEY).select("change", F.lit("reference").alias("what"), "path", "name"))
        if tool == "overview":
            return graph.overview(s, r, args.get("largest", 20))
        if tool == "top":
            counted = graph.scores(s, r, args["ranking"]).agg(F.count("*").alias("total"))
            return _paged(graph.top(s, r, args["ranking"], limit or 20), counted, limit or 20)
        if tool == "list":
            found = graph.list_symbols(s, wanted, limit or 100)
            return _paged(found.items, found.every.agg(F.count("*").alias("total")), found.limit)
        if tool == "unreferenced":
            found = graph.page(graph.unreferenced(s, r, wanted, args.get("exclude_tests", True)), limit or 100)
            return _paged(found.items, found.every.agg(F.count("*").alias("total")), found.limit)
        raise ValueError(f"unknown tool {tool!r}")
