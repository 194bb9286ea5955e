"""Ticket trackers as paged sources behind an injected HTTP function.

``http(method, url, headers, body) -> (status, headers, parsed JSON)`` is given
by the caller; nothing here opens a connection.  A tracker's pages become a
DataFrame through a Python data source whose partitions are read lazily.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.tickets import Unsupported, asana_tasks, choose_transition, column_for, github_issues, github_project_items, gitlab_issues, jira_issues, linear_issues

Http = Callable[[str, str, dict, object], tuple[int, dict, object]]


class BackendError(Exception):
    pass


@dataclass(frozen=True)
class Capabilities:
    """What a tracker can do beyond being read."""

    push: bool = False
    comments: bool = False
    transitions_required: bool = False
    custom_fields: bool = False
    single_assignee: bool = False
    hierarchy: bool = False
    relations: bool = False


@dataclass(frozen=True)
class FieldMapping:
    """Which of a tracker's own fields hold a ticket's; None for its usual."""

    title: str | None = None
    assignee: str | None = None
    priority: str | None = None
    status: str | None = None

    def renamed(self, items: DataFrame) -> DataFrame:
        """Items with the mapped columns under the tickets' names."""
        return items.withColumnsRenamed({own: name for name, own in vars(self).items() if own is not None})


def number_of(uid: str) -> int:
    """The number at the end of ``project#number``."""
    m = re.fullmatch(r"[^#]*#(\d+)", uid)
    if not m:
        raise ValueError(f"bad uid {uid!r}")
    return int(m.group(1))


def board_uid(uid: str) -> tuple[str, str, int]:
    """``owner/repository#number``."""
    m = re.fullmatch(r"([^/#]+)/([^/#]+)#(\d+)", uid)
    if not m:
        raise ValueError(f"bad uid {uid!r}")
    return m.group(1), m.group(2), int(m.group(3))


def next_link(header: str | None) -> str | None:
    """The ``rel="next"`` target of a Link header."""
    for part in (header or "").split(","):
        m = re.match(r'\s*<([^>]*)>\s*;.*rel="?next"?', part)
        if m:
            return m.group(1)
    return None


@dataclass
class Tracker:
    http: Http
    base: str
    token: str = ""
    mapping: dict | None = None
    config: dict = field(default_factory=dict)
    capabilities = Capabilities(push=True, comments=True)

    def _call(self, method: str, path: str, body: object = None) -> tuple[dict, object]:
        url = path if "://" in path else self.base + path
        status, headers, parsed = self.http(method, url, {"Authorization": f"Bearer {self.token}"}, body)
        if status >= 400:
            raise BackendError(f"{method} {url}: {status}")
        return {k.lower(): v for k, v in headers.items()}, parsed

    def page(self, cursor: str | None) -> tuple[list, str | None]:
        raise NotImplementedError

    def items(self) -> Iterator[dict]:
        """All items from the empty cursor, until it is None or unchanged."""
        cursor = None
        while True:
            found, after = self.page(cursor)
            yield from found
            if after is None or after == cursor:
                return
            cursor = after

    #: The schema of an item, and how items become tickets.
    SCHEMA = ""

    def normalise(self, items: DataFrame) -> DataFrame:
        raise Unsupported(type(self).__name__)

    def tickets(self, spark: SparkSession) -> DataFrame:
        """All items of the tracker as tickets."""
        return self.normalise(load(spark, self.items, self.SCHEMA))

    def get(self, uid: str) -> dict:
        """One item by its uid."""
        raise Unsupported(type(self).__name__)

    def set_state(self, uid: str, category: str) -> None:
        raise Unsupported(type(self).__name__)

    def comment(self, uid: str, text: str) -> None:
        raise Unsupported(type(self).__name__)

    def _signal(self) -> object:
        return self.mapping and self.mapping.get("signal")


class GitHubIssues(Tracker):
    SCHEMA = "number bigint, node_id string, title string, body string, state string, state_reason string, labels array<struct<name: string>>, assignees array<struct<login: string>>, user struct<login: string>, html_url string, pull_request struct<url: string>"

    def normalise(self, items):
        return github_issues(items, self.config["repository"])

    def page(self, cursor):
        headers, found = self._call("GET", cursor or f"/repos/{self.config['repository']}/issues?state=all&per_page=100")
        return [x for x in found if not x.get("pull_request")], next_link(headers.get("link"))

    def _issue(self, uid: str) -> str:
        return f"/repos/{self.config['repository']}/issues/{number_of(uid)}"

    def get(self, uid):
        return self._call("GET", self._issue(uid))[1]

    def set_state(self, uid, category):
        closed = category in ("Done", "Canceled")
        body = {"state": "closed", "state_reason": "completed" if category == "Done" else "not_planned"} if closed else {"state": "open"}
        self._call("PATCH", self._issue(uid), body)

    def comment(self, uid, text):
        self._call("POST", self._issue(uid) + "/comments", {"body": text})


class _GraphQL(Tracker):
    def _query(self, query: str, variables: dict) -> dict:
        """The data of an answer; its errors, or no data at all, are an error."""
        _, answer = self._call("POST", "/graphql", {"query": query, "variables": variables})
        if answer.get("errors"):
            raise BackendError("; ".join(str(e.get("message", e)) for e in answer["errors"]))
        if answer.get("data") is None:
            raise BackendError("the answer has no data")
        return answer["data"]


def _found(value: object, what: str) -> object:
    if value is None:
        raise BackendError(what)
    return value


class GitHubProject(_GraphQL):
    """The issues of a project board.  ``config``: ``owner`` (an organization)
    and ``number`` of the board; the column is its field ``Status``."""

    capabilities = Capabilities(push=True)
    ISSUE = "number title body author { login } repository { nameWithOwner } assignees(first: 10) { nodes { login } } labels(first: 20) { nodes { name } }"
    STATUS = 'fieldValueByName(name: "Status") { ... on ProjectV2ItemFieldSingleSelectValue { optionId name } }'
    ITEMS = (
        "query ($owner: String!, $board: Int!, $after: String) { organization(login: $owner) { projectV2(number: $board) { items(after: $after, first: 100) "
        f"{{ nodes {{ content {{ __typename ... on Issue {{ {ISSUE} }} }} {STATUS} }} pageInfo {{ endCursor hasNextPage }} }} }} }} }}"
    )
    CARDS = (
        "query ($owner: String!, $name: String!, $issue: Int!) { repository(name: $name, owner: $owner) { issue(number: $issue) { projectItems(first: 20) "
        '{ nodes { id project { number id field(name: "Status") { ... on ProjectV2SingleSelectField { options { name id } id } } } } } } } }'
    )
    MOVE = (
        "mutation ($board: ID!, $card: ID!, $field: ID!, $column: String!) { updateProjectV2ItemFieldValue(input: "
        "{ value: { singleSelectOptionId: $column }, fieldId: $field, itemId: $card, projectId: $board }) { projectV2Item { id } } }"
    )

    SCHEMA = "fieldValueByName struct<name: string, optionId: string>, content struct<__typename: string, number: bigint, title: string, body: string, repository: struct<nameWithOwner: string>, labels: struct<nodes: array<struct<name: string>>>, assignees: struct<nodes: array<struct<login: string>>>, author: struct<login: string>>"

    def normalise(self, items):
        return github_project_items(items, self.mapping or {"values": {}, "default": "Open"})

    def page(self, cursor):
        data = self._query(self.ITEMS, {"owner": self.config["owner"], "board": int(self.config["number"]), "after": cursor})
        board = _found((data.get("organization") or {}).get("projectV2"), f"no board {self.config['number']}")["items"]
        kept = [x for x in board["nodes"] if (x.get("content") or {}).get("__typename") == "Issue"]
        return kept, board["pageInfo"]["endCursor"] if board["pageInfo"]["hasNextPage"] else None

    def set_state(self, uid, category):
        """Move the issue's card to the column that stands for the category."""
        column = column_for(category, self.mapping or {"values": {}}, self.config.get("overrides"))
        owner, name, issue = board_uid(uid)
        data = self._query(self.CARDS, {"owner": owner, "name": name, "issue": issue})
        found = _found((data.get("repository") or {}).get("issue"), f"no issue {uid}")
        card = next((n for n in found["projectItems"]["nodes"] if n["project"]["number"] == int(self.config["number"])), None)
        board = _found(card, f"{uid} is not on board {self.config['number']}")["project"]
        status = _found(board.get("field"), "the board has no single-select field Status")
        option = next((o for o in status["options"] if o["name"].lower() == column.lower()), None)
        self._query(self.MOVE, {"board": board["id"], "card": card["id"], "field": status["id"], "column": _found(option, f"no column {column!r}")["id"]})


class Jira(Tracker):
    capabilities = Capabilities(push=True, comments=True, transitions_required=True)
    #: What ``jira_issues`` reads; without a list only ids are returned.
    FIELDS = ("summary", "description", "status", "resolution", "issuetype", "priority", "assignee", "reporter", "labels", "project")

    def get(self, uid):
        return self._call("GET", f"/rest/api/3/issue/{uid}?fields={','.join(self.FIELDS)}")[1]

    SCHEMA = "key string, id string, fields struct<summary: string, description: string, status: struct<name: string, id: string, statusCategory: struct<key: string>>, issuetype: struct<name: string>, priority: struct<name: string>, assignee: struct<accountId: string, displayName: string>, reporter: struct<accountId: string, displayName: string>, labels: array<string>, project: struct<key: string, name: string>, resolution: struct<name: string>>"

    def normalise(self, items):
        return jira_issues(items, self.mapping)

    def page(self, cursor):
        body = {"jql": self.config.get("jql", ""), "fields": list(self.FIELDS), "maxResults": 100} | ({"nextPageToken": cursor} if cursor else {})
        _, found = self._call("POST", "/rest/api/3/search/jql", body)
        return found["issues"], found.get("nextPageToken")

    def set_state(self, uid, category):
        _, found = self._call("GET", f"/rest/api/3/issue/{uid}/transitions")
        steps = [{"id": t["id"], "name": t["to"]["name"], "category": t["to"]["statusCategory"]["key"]} for t in found["transitions"]]
        step = choose_transition(steps, category)
        if step is None:
            raise Unsupported(f"no transition of {uid} to {category}")
        self._call("POST", f"/rest/api/3/issue/{uid}/transitions", {"transition": {"id": step["id"]}})

    def comment(self, uid, text):
        paragraph = {"type": "paragraph", "content": [{"type": "text", "text": text}]}
        self._call("POST", f"/rest/api/3/issue/{uid}/comment", {"body": {"type": "doc", "version": 1, "content": [paragraph]}})


class Linear(_GraphQL):
    TYPES = {"Triage": "triage", "Backlog": "backlog", "Open": "unstarted", "InProgress": "started", "Pending": "started", "Done": "completed", "Canceled": "canceled"}
    ISSUE = "identifier id priority title description assignee { displayName } creator { displayName } team { name key } project { name } state { type name } labels { nodes { name } }"
    ISSUES = f"query ($after: String, $first: Int) {{ issues(after: $after, first: $first) {{ nodes {{ {ISSUE} }} pageInfo {{ endCursor hasNextPage }} }} }}"
    ONE = f"query ($uid: String!) {{ issue(id: $uid) {{ {ISSUE} }} }}"
    STATES = "query ($uid: String!) { issue(id: $uid) { team { states { nodes { type id } } } } }"
    MOVE = "mutation ($uid: String!, $state: String!) { issueUpdate(input: { stateId: $state }, id: $uid) { success } }"
    COMMENT = "mutation ($uid: String!, $text: String!) { commentCreate(input: { body: $text, issueId: $uid }) { success } }"

    SCHEMA = "id string, identifier string, title string, description string, priority int, state struct<name: string, type: string>, assignee struct<displayName: string>, creator struct<displayName: string>, labels struct<nodes: array<struct<name: string>>>, team struct<key: string, name: string>, project struct<name: string>"

    def normalise(self, items):
        return linear_issues(items, self.mapping)

    def page(self, cursor):
        found = self._query(self.ISSUES, {"first": 100, "after": cursor})["issues"]
        return found["nodes"], found["pageInfo"]["endCursor"] if found["pageInfo"]["hasNextPage"] else None

    def get(self, uid):
        return _found(self._query(self.ONE, {"uid": uid}).get("issue"), f"no issue {uid}")

    def _done(self, mutation: str, name: str, variables: dict) -> None:
        if not self._query(mutation, variables)[name]["success"]:
            raise BackendError(f"{name} was refused")

    def set_state(self, uid, category):
        """States belong to teams: that of the issue's team with the type."""
        issue = _found(self._query(self.STATES, {"uid": uid}).get("issue"), f"no issue {uid}")
        state = next((s for s in issue["team"]["states"]["nodes"] if s["type"] == self.TYPES[category]), None)
        self._done(self.MOVE, "issueUpdate", {"uid": uid, "state": _found(state, f"the team has no state of type {self.TYPES[category]!r}")["id"]})

    def comment(self, uid, text):
        self._done(self.COMMENT, "commentCreate", {"uid": uid, "text": text})


class GitLab(Tracker):
    SCHEMA = "iid bigint, title string, description string, state string, labels array<string>, assignees array<struct<username: string>>, author struct<username: string>, issue_type string, references struct<full: string>"

    def normalise(self, items):
        return gitlab_issues(items, self.config["project"], self.mapping)

    def page(self, cursor):
        headers, found = self._call("GET", f"/api/v4/projects/{self.config['project'].replace('/', '%2F')}/issues?per_page=100&page={cursor or 1}")
        return found, headers.get("x-next-page") or None

    def _issue(self, uid: str) -> str:
        return f"/api/v4/projects/{self.config['project'].replace('/', '%2F')}/issues/{number_of(uid)}"

    def get(self, uid):
        return self._call("GET", self._issue(uid))[1]

    def set_state(self, uid, category):
        terminal = category in ("Done", "Canceled")
        signal = self._signal()
        if not terminal and signal and signal[0] == "scoped_label":
            raise Unsupported("the state is a label")
        self._call("PUT", self._issue(uid), {"state_event": "close" if terminal else "reopen"})

    def comment(self, uid, text):
        self._call("POST", self._issue(uid) + "/notes", {"body": text})


class Asana(Tracker):
    FIELDS = "gid,name,notes,html_notes,completed,assignee.name,created_by.name,memberships.project.name,memberships.section.name,custom_fields,tags.name,permalink_url"

    SCHEMA = "gid string, name string, notes string, html_notes string, completed boolean, assignee struct<name: string>, created_by struct<name: string>, memberships array<struct<project: struct<gid: string, name: string>, section: struct<name: string>>>, custom_fields array<struct<gid: string, enum_value: struct<name: string>, display_value: string>>, tags array<struct<name: string>>, permalink_url string"

    def normalise(self, items):
        return asana_tasks(items, self.mapping)

    def page(self, cursor):
        _, found = self._call("GET", f"/api/1.0/projects/{self.config['project']}/tasks?limit=100&opt_fields={self.FIELDS}" + (f"&offset={cursor}" if cursor else ""))
        return found["data"], (found.get("next_page") or {}).get("offset")

    def get(self, uid):
        return self._call("GET", f"/api/1.0/tasks/{uid}?opt_fields={self.FIELDS}")[1]["data"]

    def set_state(self, uid, category):
        terminal = category in ("Done", "Canceled")
        if not terminal and self._signal() == "section":
            raise Unsupported("the state is a section")
        self._call("PUT", f"/api/1.0/tasks/{uid}", {"data": {"completed": terminal}})

    def comment(self, uid, text):
        self._call("POST", f"/api/1.0/tasks/{uid}/stories", {"data": {"text": text}})


REGISTRY = {"github": GitHubIssues, "github-projects": GitHubProject, "jira": Jira, "linear": Linear, "gitlab": GitLab, "asana": Asana}


def select_connection(connections: list[dict], name: str | None = None) -> dict:
    """The one that is named, or the only one."""
    found = [c for c in connections if name is None or c["name"] == name]
    if len(found) != 1:
        raise LookupError(f"{len(found)} connections match {name!r}")
    return found[0]


def connect(config: str, http: Http, name: str | None = None) -> Tracker:
    """A tracker from TOML: ``[[connection]]`` tables with ``name``, ``kind``,
    ``base``, ``token``, and what the kind needs."""
    import tomllib

    c = dict(select_connection(tomllib.loads(config).get("connection", []), name))
    kind = c.pop("kind")
    if kind not in REGISTRY:
        raise LookupError(f"unknown kind {kind!r}")
    mapping = c.pop("mapping", None)
    if mapping and isinstance(mapping.get("signal"), list):
        mapping["signal"] = tuple(mapping["signal"])
    return REGISTRY[kind](http, c.pop("base", ""), c.pop("token", ""), mapping, c)


def load(spark: SparkSession, items: Callable[[], Iterator[dict]], schema: str) -> DataFrame:
    """Items as rows of ``schema``, read where Spark runs the partition.

    ``items`` is called there, once; it yields dicts, in which nested rich
    documents may stand for JSON strings.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(0)]

        def read(self, partition):
            for x in items():
                yield (json.dumps(x),)

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "tracker_pages"

        def schema(self):
            return "item string"

        def reader(self, schema):
            return Reader()

    from pyspark.sql import functions as F

    spark.dataSource.register(Pages)
    raw = spark.read.format("tracker_pages").load()
    return raw.select(F.from_json("item", schema).alias("x")).select("x.*")
