from ledgerloom.streaming.watch import Debouncer, quiet_groups, watch, watch_tree


def test_debouncer_waits_for_quiet():
    now = [0.0]
    d = Debouncer(0.5, lambda: now[0])
    assert not d.due()
    d.event()
    now[0] = 0.4
    d.event()
    now[0] = 0.8
    assert not d.due()
    now[0] = 0.95
    assert d.due() and not d.due()


def test_watch_indexes_new_files(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def a(): pass")
    seen, now = [], [0.0]
    full = []

    def on_files(df):
        seen.extend(r["path"].rsplit("/", 1)[-1] for r in df.collect())
        now[0] += 400
        if "bad.py" in seen:
            raise ValueError("bad file")

    once = lambda: watch(spark, str(root), on_files, str(tmp_path / "ck"), lambda: full.append(1), {"availableNow": True}, lambda: now[0]).awaitTermination()
    once()
    (root / "bad.py").write_text("x")
    once()
    assert sorted(seen) == ["a.py", "bad.py"] and full == [1]


def test_quiet_groups_stream(spark, tmp_path):
    import time

    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "1.json").write_text('{"key": "a"}\n{"key": "a"}\n{"key": "b"}\n')
    events = spark.readStream.schema("key string").json(str(folder))
    q = quiet_groups(events, 200).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("quiet").count() < 2:
            time.sleep(0.5)
        assert {r["key"]: r["events"] for r in spark.table("quiet").collect()} == {"a": 2, "b": 1}
    finally:
        q.stop()


def test_watch_tree_sees_changes_and_deletions(spark, tmp_path):
    import time

    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("one")
    (root / "b.py").write_text("two")
    turns = []

    def on_changes(files, deleted):
        name = lambda r: r["path"].rsplit("/", 1)[-1]
        turns.append((sorted((name(r), bytes(r["content"]).decode()) for r in files.collect()), sorted(name(r) for r in deleted.collect())))
        if len(turns) == 2:
            raise ValueError("comes again")

    q = watch_tree(spark, str(root), on_changes, str(tmp_path / "state"), {"processingTime": "200 milliseconds"})
    try:

        def until(n):
            deadline = time.time() + 90
            while time.time() < deadline and len(turns) < n:
                time.sleep(0.2)

        until(1)
        (root / "a.py").write_text("one and more")
        (root / "b.py").unlink()
        (root / "c.py").write_text("three")
        until(3)
    finally:
        q.stop()
    assert turns[0] == ([("a.py", "one"), ("b.py", "two")], [])
    files, deleted = {}, set()
    for f, d in turns[2:]:
        files |= dict(f)
        deleted |= set(d)
    assert ("c.py" in files or ("c.py", "three") in turns[1][0]) and files.get("a.py", "one and more") == "one and more" and "b.py" in deleted | set(turns[1][1])
