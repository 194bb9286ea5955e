import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import tickets as t
from ledgerloom.operators.store import RecordStore
from ledgerloom.operators.tickets import ingest
from ledgerloom.sources import trackers


def rows(spark, items, schema):
    return spark.createDataFrame([(json.dumps(x),) for x in items], "j string").select(F.from_json("j", schema).alias("x")).select("x.*")


GH = "number bigint, node_id string, title string, body string, state string, state_reason string, labels array<struct<name: string>>, assignees array<struct<login: string>>, user struct<login: string>, html_url string, pull_request struct<url: string>"


def test_github(spark):
    items = [{"number": 1, "node_id": "N", "title": "T", "state": "closed", "state_reason": "completed", "labels": [{"name": "x"}], "assignees": [{"login": "a"}], "user": {"login": "u"}, "html_url": "h"}, {"number": 2, "pull_request": {"url": "p"}}, {"number": 3, "node_id": "M", "title": "W", "state": "closed", "state_reason": "not_planned", "html_url": "h"}]
    got = t.github_issues(rows(spark, items, GH), "o/r").collect()
    assert [(r["uid"], r["state"]["category"], r["state"]["resolution"]) for r in got] == [("o/r#1", "Done", "Done"), ("o/r#3", "Canceled", "WontDo")]
    assert [(a["role"], a["handle"]) for a in got[0]["actors"]] == [("Assignee", "a"), ("Submitter", "u")]
    assert got[0]["fields"] == {"html_url": '"h"'} and got[1]["labels"] == []


def test_project_items(spark):
    schema = "fieldValueByName struct<name: string, optionId: string>, content struct<__typename: string, number: bigint, title: string, body: string, repository struct<nameWithOwner: string>, labels struct<nodes: array<struct<name: string>>>, assignees struct<nodes: array<struct<login: string>>>, author struct<login: string>>".replace("repository struct", "repository: struct").replace("labels struct", "labels: struct").replace("assignees struct", "assignees: struct").replace("author struct", "author: struct")
    items = [{"fieldValueByName": {"name": "almost DONE", "optionId": "o"}, "content": {"__typename": "Issue", "number": 4, "title": "T", "repository": {"nameWithOwner": "o/r"}}}, {"content": {"__typename": "DraftIssue", "title": "d"}}, {"content": {"__typename": "PullRequest", "number": 1}}, {"content": {"__typename": "Issue", "number": 5, "repository": {"nameWithOwner": "o/r"}}}]
    got = t.github_project_items(rows(spark, items, schema), {"values": {"Almost done": "InProgress"}, "default": "Open"}).collect()
    assert [(r["uid"], r["state"]["category"], r["state"]["raw_name"]) for r in got] == [("o/r#4", "InProgress", "almost DONE"), ("o/r#5", "Open", "")]


def test_jira(spark):
    schema = "key string, id string, fields struct<summary: string, description: string, status: struct<name: string, id: string, statusCategory: struct<key: string>>, issuetype: struct<name: string>, priority: struct<name: string>, assignee: struct<accountId: string, displayName: string>, reporter: struct<accountId: string, displayName: string>, labels: array<string>, project: struct<key: string, name: string>, resolution: struct<name: string>>"
    adf = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "hello"}]}]}
    status = lambda n, c: {"name": n, "id": "1", "statusCategory": {"key": c}}
    items = [{"key": "P-1", "id": "10", "fields": {"summary": "S", "description": adf, "status": status("Review", "indeterminate"), "priority": {"name": "Blocker"}, "assignee": {"displayName": "Ann"}, "labels": ["l"], "project": {"key": "P", "name": "Proj"}, "resolution": {"name": "Won't Fix"}}}, {"key": "P-2", "id": "11", "fields": {"summary": "S", "status": status("Blocked", "new"), "resolution": {"name": "Odd"}}}]
    got = t.jira_issues(rows(spark, items, schema), {"values": {"Blocked": "Pending", "review": "Open"}, "default": "Open"}).collect()
    assert [(r["state"]["category"], r["state"]["resolution"]) for r in got] == [("InProgress", "WontDo"), ("Pending", "Odd")]
    assert got[0]["body"]["markdown"] == "hello" and got[0]["priority"]["level"] == "Urgent" and got[0]["actors"][0]["handle"] == "Ann"
    assert got[1]["containers"] == [] and got[1]["priority"] is None and got[1]["item_type"] == "issue"


def test_linear_gitlab_asana(spark):
    linear = "id string, identifier string, title string, description string, priority int, state struct<name: string, type: string>, assignee struct<displayName: string>, creator struct<displayName: string>, labels struct<nodes: array<struct<name: string>>>, team struct<key: string, name: string>, project struct<name: string>"
    r = t.linear_issues(rows(spark, [{"id": "i", "identifier": "E-1", "title": "T", "priority": 1, "state": {"name": "Doing", "type": "started"}, "team": {"key": "E", "name": "Eng"}, "project": {"name": "Q"}, "labels": {"nodes": []}}], linear)).first()
    assert (r["state"]["category"], r["priority"]["level"], [c["primary"] for c in r["containers"]]) == ("InProgress", "Urgent", [True, False])
    gitlab = "iid bigint, title string, description string, state string, labels array<string>, assignees array<struct<username: string>>, author struct<username: string>, issue_type string, references struct<full: string>"
    mapping = {"values": {"doing": "InProgress"}, "default": "Backlog", "signal": ("scoped_label", "workflow::")}
    got = t.gitlab_issues(rows(spark, [{"iid": 1, "title": "a", "state": "opened", "labels": ["x", "workflow::Doing"]}, {"iid": 2, "title": "b", "state": "closed", "labels": ["workflow::doing"], "references": {"full": "g/p#2"}}, {"iid": 3, "title": "c", "state": "opened", "labels": []}], gitlab), "g/p", mapping).collect()
    assert [(r["uid"], r["state"]["category"], r["state"]["raw_name"]) for r in got] == [("g/p#1", "InProgress", "workflow::Doing"), ("g/p#2", "Done", "closed"), ("g/p#3", "Open", "opened")]
    asana = "gid string, name string, notes string, html_notes string, completed boolean, assignee struct<name: string>, created_by struct<name: string>, memberships array<struct<project: struct<gid: string, name: string>, section: struct<name: string>>>, custom_fields array<struct<gid: string, enum_value: struct<name: string>, display_value: string>>, tags array<struct<name: string>>, permalink_url string"
    task = {"gid": "7", "name": "n", "completed": False, "memberships": [{"section": {"name": "Doing"}}, {"project": {"gid": "p", "name": "Q3"}}], "custom_fields": [{"gid": "f", "display_value": "late"}], "tags": [{"name": "t"}], "html_notes": "<b>"}
    frame = rows(spark, [task], asana)
    r = t.asana_tasks(frame, {"values": {"Doing": "InProgress"}, "default": "Open", "signal": "section"}).first()
    assert (r["state"]["category"], r["body"]["format"], [(c["id"], c["primary"]) for c in r["containers"]]) == ("InProgress", "Html", [("p", False)])
    assert t.asana_tasks(frame, {"values": {"late": "Pending"}, "default": "Open", "signal": ("custom_field", "f")}).first()["state"]["category"] == "Pending"
    assert t.asana_tasks(frame).first()["state"]["raw_name"] == "incomplete"
    assert t.violations(t.asana_tasks(frame)).count() == 0


def test_ingest_is_idempotent(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path))
    item = lambda n, title: {"number": n, "node_id": "N", "title": title, "state": "open", "html_url": "h"}
    load = lambda *x: t.github_issues(rows(spark, x, GH), "o/r")
    assert tuple(ingest(store, load(item(1, "a"), item(2, "b")), "me").first()) == (2, 0, 0)
    assert tuple(ingest(store, load(item(1, "a"), item(2, "c"), item(3, "d")), "me").first()) == (1, 1, 1)
    assert {r["id"]: r["revision"]["counter"] for r in store.list("tickets", "github").collect()} == {"o/r#1": 0, "o/r#2": 1, "o/r#3": 0}
    assert tuple(ingest(store, load(item(1, "a")), "me", "board").first()) == (1, 0, 0)


def test_mappings_and_transitions():
    mapping = {"values": {"A": "Open", "B": "Done", "C": "Done"}, "default": "Triage"}
    assert t.column_for("Open", mapping) == "A" and t.column_for("Done", mapping, {"Done": "B"}) == "B"
    with pytest.raises(t.Unmapped):
        t.column_for("Triage", mapping)
    with pytest.raises(t.Ambiguous):
        t.column_for("Done", mapping)
    steps = [{"name": "Cancelled", "category": "done"}, {"name": "Shipped", "category": "done"}]
    assert t.choose_transition(steps, "Done")["name"] == "Shipped" and t.choose_transition(steps, "Canceled")["name"] == "Cancelled"
    assert t.choose_transition(steps, "Open") is None and t.choose_transition(steps[1:], "Canceled")["name"] == "Shipped"
    assert t.parse_category("in_progress") == "InProgress"


def test_paged_sources(spark):
    calls = []

    def http(method, url, headers, body):
        calls.append((method, url, body))
        if "issues?" in url or "page=2" in url:
            second = "page=2" in url
            return 200, {"Link": "" if second else '<https://x/repos/o/r/issues?page=2>; rel="next", <y>; rel="last"'}, [{"number": 2 if second else 1}, {"number": 9, "pull_request": {"url": "p"}}]
        return (500, {}, None) if "comments" in url else (200, {}, {})

    tracker = trackers.connect('[[connection]]\nname="g"\nkind="github"\nbase="https://x"\nrepository="o/r"\n', http)
    assert [x["number"] for x in tracker.items()] == [1, 2]
    tracker.set_state("o/r#4", "Canceled")
    assert calls[-1] == ("PATCH", "https://x/repos/o/r/issues/4", {"state": "closed", "state_reason": "not_planned"})
    with pytest.raises(trackers.BackendError):
        tracker.comment("o/r#4", "x")
    pages = {None: (["a", "b"], "1"), "1": (["c"], "1")}

    class Fixed(trackers.Tracker):
        def page(self, cursor):
            return [{"k": x} for x in pages[cursor][0]], pages[cursor][1]

    fixed = Fixed(http, "")
    assert [x["k"] for x in fixed.items()] == ["a", "b", "c"]  # an unchanged cursor ends it
    items = [{"k": x, "n": {"m": 1}} for x in "abc"]
    assert [tuple(r) for r in trackers.load(spark, lambda: iter(items), "k string, n struct<m: int>").select("k", "n.m").collect()] == [("a", 1), ("b", 1), ("c", 1)]
    gitlab = trackers.GitLab(http, "https://x", "", {"values": {}, "default": "Open", "signal": ("scoped_label", "w::")}, {"project": "g/p"})
    with pytest.raises(trackers.Unsupported):
        gitlab.set_state("g/p#1", "InProgress")
    with pytest.raises(trackers.Unsupported):
        trackers.GitHubProject(http, "").comment("x", "y")
    with pytest.raises(LookupError):
        trackers.select_connection([{"name": "a"}, {"name": "b"}])


class Recorded:
    """An HTTP function that keeps its calls and answers from a list."""

    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def __call__(self, method, url, headers, body):
        self.calls.append((method, url, body))
        return 200, {}, self.answers.pop(0)


def fields_of(query):
    """A GraphQL text as nested sets of field names, which must be balanced."""
    stack, last = [{}], None
    for token in re.findall(r"[{}]|\.\.\. on \w+|\([^)]*\)|\w+", query):
        if token == "{":
            stack.append(stack[-1].setdefault(last, {}))
        elif token == "}":
            stack.pop()
        elif token[0] != "(":
            last = token
            stack[-1].setdefault(token, {})
    assert len(stack) == 1
    return stack[0]


def test_board_queries():
    node = {"content": {"__typename": "Issue", "number": 4}}
    items = {"data": {"organization": {"projectV2": {"items": {"nodes": [node, {"content": {"__typename": "DraftIssue"}}, {"content": None}], "pageInfo": {"hasNextPage": False, "endCursor": "z"}}}}}}
    cards = {"data": {"repository": {"issue": {"projectItems": {"nodes": [{"id": "c0", "project": {"number": 1}}, {"id": "c7", "project": {"number": 7, "id": "B", "field": {"id": "F", "options": [{"id": "o1", "name": "Todo"}, {"id": "o2", "name": "Shipped"}]}}}]}}}}}
    http = Recorded(items, cards, {"data": {"updateProjectV2ItemFieldValue": {}}})
    board = trackers.GitHubProject(http, "https://api", "t", {"values": {"shipped": "Done"}, "default": "Open"}, {"owner": "acme", "number": 7})
    assert board.page(None) == ([node], None)
    board.set_state("acme/shop#4", "Done")
    (_, url, first), (_, _, second), (_, _, third) = http.calls
    assert url == "https://api/graphql" and first["variables"] == {"owner": "acme", "board": 7, "after": None}
    tree = fields_of(first["query"])["query"]["organization"]["projectV2"]["items"]
    issue = tree["nodes"]["content"]["... on Issue"]
    assert {"number", "title", "body", "author", "repository", "assignees", "labels"} <= set(issue) and set(tree["pageInfo"]) == {"endCursor", "hasNextPage"}
    assert set(tree["nodes"]["fieldValueByName"]["... on ProjectV2ItemFieldSingleSelectValue"]) == {"name", "optionId"}
    assert second["variables"] == {"owner": "acme", "name": "shop", "issue": 4}
    assert third["variables"] == {"board": "B", "card": "c7", "field": "F", "column": "o2"} and "updateProjectV2ItemFieldValue" in third["query"]
    for answer in ({"errors": [{"message": "bad"}]}, {"data": None}, {"data": {"organization": None}}):
        with pytest.raises(trackers.BackendError):
            trackers.GitHubProject(Recorded(answer), "", config={"owner": "o", "number": 1}).page(None)
    with pytest.raises(ValueError):
        trackers.board_uid("shop#4")


def test_linear_queries():
    states = {"data": {"issue": {"team": {"states": {"nodes": [{"id": "s1", "type": "started"}, {"id": "s2", "type": "completed"}]}}}}}
    page = {"data": {"issues": {"nodes": [{"id": "i"}], "pageInfo": {"hasNextPage": True, "endCursor": "n"}}}}
    http = Recorded(page, states, {"data": {"issueUpdate": {"success": True}}}, {"data": {"commentCreate": {"success": False}}}, states, {"data": {"issue": None}})
    linear = trackers.Linear(http, "https://l")
    assert linear.page("c") == ([{"id": "i"}], "n")
    linear.set_state("i", "Done")
    for call in (lambda: linear.comment("i", "text"), lambda: linear.set_state("i", "Triage"), lambda: linear.get("i")):
        with pytest.raises(trackers.BackendError):
            call()
    bodies = [c[2] for c in http.calls]
    issue = fields_of(bodies[0]["query"])["query"]["issues"]["nodes"]
    assert {"id", "identifier", "title", "description", "priority", "state", "assignee", "creator", "labels", "team", "project"} <= set(issue)
    assert bodies[0]["variables"] == {"first": 100, "after": "c"} and bodies[2]["variables"] == {"uid": "i", "state": "s2"}
    assert "issueUpdate" in bodies[2]["query"] and bodies[3]["variables"] == {"uid": "i", "text": "text"} and "commentCreate" in bodies[3]["query"]


def test_other_trackers_ask_for_what_they_read():
    http = Recorded({"issues": [], "nextPageToken": "t"}, {"key": "P-1"}, {"iid": 3}, {"data": {"gid": "9"}}, {"number": 2})
    jira = trackers.Jira(http, "https://j", config={"jql": "project = P"})
    assert jira.page("t") == ([], "t") and jira.get("P-1") == {"key": "P-1"}
    body = http.calls[0][2]
    assert body["jql"] == "project = P" and body["nextPageToken"] == "t"
    assert {"summary", "description", "status", "resolution", "issuetype", "priority", "assignee", "reporter", "labels", "project"} == set(body["fields"])
    assert trackers.GitLab(http, "", config={"project": "g/p"}).get("g/p#3") == {"iid": 3} and http.calls[-1][1] == "/api/v4/projects/g%2Fp/issues/3"
    assert trackers.Asana(http, "").get("9") == {"gid": "9"} and trackers.GitHubIssues(http, "", config={"repository": "o/r"}).get("o/r#2") == {"number": 2}
    flags = trackers.Jira.capabilities
    assert flags.push and flags.comments and flags.transitions_required and not flags.hierarchy
    assert not trackers.GitHubProject.capabilities.comments


def test_field_mapping(spark):
    items = spark.createDataFrame([("a", "b")], "col7 string, person string")
    assert trackers.FieldMapping(title="col7", assignee="person").renamed(items).columns == ["title", "assignee"]
