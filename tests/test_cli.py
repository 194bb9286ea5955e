import json

from ledgerloom import cli


def test_migrate_list_sync(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("hello")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")

    def run(*argv):
        assert cli.main(list(argv), spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert run("--store", a, "migrate", str(tmp_path / "src")) == [{"outcome": "committed", "n": 1}]
    assert run("--store", a, "sync", b) == [{"action": "copied_to_b", "n": 1}]
    assert run("--store", b, "list") == [{"namespace": "files", "collection": "docs", "id": "a.md"}]
    assert run("--store", b, "get", "files", "docs", "a.md")[0]["body"]["inline"] == "hello"
    assert run("--store", b, "status")[0]["n"] == 1
    assert run("--store", b, "gc") == [{"freed": 0, "retained": 0}]
    assert len(run("--store", b, "history")) == 1


def test_index_gc_tickets_and_push(spark, tmp_path, capsys):
    src, a, b = tmp_path / "src", str(tmp_path / "a"), str(tmp_path / "b")
    src.mkdir()
    (src / "m.py").write_text("def f():\n    g()\n")
    (src / "n.py").write_text("def h():\n    pass\n")
    calls = []

    def http(method, url, headers, body):
        calls.append((method, url, body))
        return 200, {}, [{"number": 1, "node_id": "N", "title": "T", "state": "open", "html_url": "h"}] if method == "GET" else {}

    def run(*argv):
        assert cli.main(list(argv), spark, http) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    index = ("--store", a, "index", str(src), "--repo", "r", "--view", "v")
    assert run(*index) == [{"change": "added", "n": 2}]
    (src / "n.py").write_text("def other():\n    pass\n")
    assert run(*index) == [{"change": "modified", "n": 1}, {"change": "unchanged", "n": 1}]
    assert run(*index) == [{"change": "unchanged", "n": 2}]
    assert run("--store", a, "gc") == [{"freed": 1, "retained": 2}]
    assert run("--store", a, "push", b) == [{"fast_forwarded": True, "version": 2}]
    config = tmp_path / "c.toml"
    config.write_text('[[connection]]\nname="g"\nkind="github"\nbase="https://x"\nrepository="o/r"\n')
    ticket = ("--store", a, "ticket", "--config", str(config))
    assert run(*ticket, "sync") == [{"imported": 1, "updated": 0, "unchanged": 0}]
    assert run("--store", a, "ticket", "list") == [{"collection": "github", "id": "o/r#1"}]
    assert json.loads(run("--store", a, "ticket", "--uid", "o/r#1", "get")[0]["ticket"])["title"] == "T"
    run(*ticket, "--uid", "o/r#1", "--category", "done", "move")
    assert calls[-1][0] == "PATCH" and calls[-1][2]["state_reason"] == "completed"
    assert run("--store", a, "vacuum")[0]["removed"] >= 1
