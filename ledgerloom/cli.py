"""Command line: ``python -m ledgerloom.cli --store DIR COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _http(method: str, url: str, headers: dict, body: object) -> tuple[int, dict, object]:
    """An HTTP call with JSON either way, by the standard library."""
    import urllib.error
    import urllib.request

    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            raw = answer.read()
            return answer.status, dict(answer.headers), json.loads(raw) if raw else None
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), None


def _index(store, files, repo: str, view: str, include: list[str]):
    """Index files into a view's manifest record and blobs; counts by change."""
    from .functions.keys import content_hash
    from .operators.index import index
    from .operators.manifest import from_body, to_body

    held = store.get(repo, "graph_manifest", view)
    bodies = held.select(F.col("namespace").alias("repo"), F.col("id").alias("view_id"), F.col("body.inline").cast("string").alias("body"))
    done = index(files, repo, view, from_body(bodies), include)
    store.put_blobs(done.blobs)
    made = to_body(done.manifest).select(F.col("repo").alias("namespace"), F.lit("graph_manifest").alias("collection"), F.col("view_id").alias("id"), F.col("body").cast("binary").alias("content"))
    now = held.select("namespace", "collection", "id", F.col("revision").alias("expected"))
    rows = made.join(now, ["namespace", "collection", "id"], "left")
    none = F.lit(None)
    put = rows.where(F.col("expected").isNull() | (F.col("expected.hash") != content_hash("content"))).select(
        "namespace", "collection", "id", F.lit("graph_manifest").alias("kind"),
        F.struct(F.coalesce(F.col("expected.counter") + 1, F.lit(0)).cast("long").alias("counter"), content_hash("content").alias("hash")).alias("revision"), F.col("expected").alias("parent"),
        F.struct(F.col("content").alias("inline"), none.cast("string").alias("blob_hash"), none.cast("long").alias("blob_len")).alias("body"),
        F.struct(F.struct(F.lit("index").alias("id"), none.cast("string").alias("display")).alias("author"), F.lit("index").alias("origin_system"), F.lit(0).cast("long").alias("created"), F.lit(0).cast("long").alias("updated"), F.from_json(F.lit("{}"), "map<string, string>").alias("labels")).alias("meta"),
        F.array().cast("array<struct<namespace: string, collection: string, id: string>>").alias("links"), "expected",
    )
    report = store._stored(done.changes.groupBy("change").agg(F.count("*").alias("n")))
    store.put(put, author="index")
    return report


def _ticket(store, args, http, show) -> int:
    """List and read stored tickets; fetch or move those of a tracker."""
    from .functions import tickets as t
    from .operators.tickets import ingest
    from .sources import trackers

    if args.action == "list":
        show(store.list("tickets").select("collection", "id").orderBy("collection", "id"))
        return 0
    if args.action == "get":
        show(store.list("tickets").where(F.col("id") == args.uid).select("id", F.col("body.inline").cast("string").alias("ticket")))
        return 0
    with open(args.config) as f:
        tracker = trackers.connect(f.read(), http, args.connection)
    if args.action == "move":
        tracker.set_state(args.uid, t.parse_category(args.category))
        return 0
    rows = tracker.tickets(store.spark)
    show(ingest(store, rows, "ticket-sync"))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, http=_http) -> int:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("status", "history", "gc", "vacuum"):
        sub.add_parser(name)
    ix = sub.add_parser("index")
    ix.add_argument("source")
    ix.add_argument("--repo", required=True)
    ix.add_argument("--view", required=True)
    ix.add_argument("--include", action="append", default=[])
    for name in ("pull", "push"):
        sub.add_parser(name).add_argument("other")
    tk = sub.add_parser("ticket")
    tk.add_argument("action", choices=("sync", "list", "get", "move"))
    tk.add_argument("--config", help="TOML of the tracker connections")
    tk.add_argument("--connection")
    tk.add_argument("--uid")
    tk.add_argument("--category")
    ls = sub.add_parser("list")
    ls.add_argument("--namespace")
    ls.add_argument("--collection")
    get = sub.add_parser("get")
    for a in ("namespace", "collection", "id"):
        get.add_argument(a)
    mv = sub.add_parser("migrate")
    mv.add_argument("source")
    mv.add_argument("--namespace", default="files")
    mv.add_argument("--collection", default="docs")
    mv.add_argument("--kind", default="topic")
    mv.add_argument("--author", default="cli")
    sy = sub.add_parser("sync")
    sy.add_argument("other")
    args = p.parse_args(argv)

    from .operators import sync
    from .operators.store import RecordStore
    from .sources.files import file_tree, migrate

    spark = spark or SparkSession.builder.appName("ledgerloom").getOrCreate()
    store = RecordStore(spark, args.store)
    show = lambda df: [print(json.dumps(r.asDict(True), default=lambda b: bytes(b).decode("utf-8", "replace"))) for r in df.toLocalIterator()]
    if args.command == "status":
        show(store.status().orderBy("namespace", "collection"))
    elif args.command == "history":
        [print(json.dumps(h)) for h in store.history()]
    elif args.command == "list":
        show(store.list(args.namespace, args.collection).select("namespace", "collection", "id").orderBy("namespace", "collection", "id"))
    elif args.command == "get":
        show(store.get(args.namespace, args.collection, args.id))
    elif args.command == "migrate":
        made = store.put(migrate(file_tree(spark, args.source), store.records(), args.namespace, args.collection, args.kind, args.author))
        show(made.groupBy("outcome").agg(F.count("*").alias("n")))
    elif args.command == "gc":
        show(store.collect_garbage())
    elif args.command == "vacuum":
        print(json.dumps({"removed": store.vacuum()}))
    elif args.command in ("pull", "push"):
        print(json.dumps(getattr(store, args.command)(RecordStore(spark, args.other))))
    elif args.command == "index":
        show(_index(store, file_tree(spark, args.source), args.repo, args.view, args.include).orderBy("change"))
    elif args.command == "ticket":
        return _ticket(store, args, http, show)
    else:
        other = RecordStore(spark, args.other)
        for _ in range(sync.MAX_PASSES):
            base, base_other = store.version(), other.version()
            done = sync.sync(store.records(base), other.records(base_other), store.blobs().select("hash", "content"))
            report = store._stored(done.report)
            counted = report.groupBy("action").agg(F.count("*").alias("n"))
            changes = {r["action"] for r in counted.collect()} - {"same", "conflict"}
            # the other store first: if this one was written meanwhile, the
            # next pass takes what the other has by then, and loses nothing
            if not changes or (other.replace(base_other, done.b, "sync") and store.replace(base, done.a, "sync")):
                show(counted)
                return 0
        print("sync did not settle", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
