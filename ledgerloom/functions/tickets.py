"""Normalised tickets: every tracker's items as one nested schema.

A mapping is ``{"values": {raw status: category}, "default": category,
"signal": ...}``; the signal says which part of an item is its status:
``("scoped_label", prefix)``, ``"completed"``, ``"section"`` or
``("custom_field", id)``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import rich_text

CATEGORIES = ("Triage", "Backlog", "Open", "InProgress", "Pending", "Done", "Canceled")
PRIORITIES = ("None", "Low", "Medium", "High", "Urgent")
SLUGS = {"GitHub": "github", "Jira": "jira", "Linear": "linear", "GitLab": "gitlab", "Asana": "asana", "AzureDevOps": "azure-devops", "Bugzilla": "bugzilla"}

TICKET = (
    "provider string, uid string, display string, item_type string, title string, "
    "state struct<category: string, resolution: string, raw_name: string, raw_id: string>, "
    "priority struct<level: string, raw: string>, actors array<struct<role: string, handle: string, display: string>>, "
    "labels array<string>, containers array<struct<kind: string, id: string, name: string, primary: boolean>>, "
    "links array<struct<kind: string, target: string>>, body struct<markdown: string, format: string, raw: string>, fields map<string, string>"
)


class Unmapped(Exception):
    pass


class Ambiguous(Exception):
    pass


class Unsupported(Exception):
    pass


def _map(pairs: Mapping[str, str]) -> Column:
    if not pairs:
        return F.from_json(F.lit("{}"), "map<string, string>")
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def category_of(raw: Column, mapping: Mapping) -> Column:
    """Exact, then regardless of ASCII case, else the default."""
    values = mapping["values"]
    folded: dict[str, str] = {}
    for k in sorted(values):
        folded.setdefault("".join(c.lower() if c.isascii() else c for c in k), values[k])
    lowered = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.element_at(_map(values), raw), F.element_at(_map(folded), lowered), F.lit(mapping["default"]))


def exact_or(raw: Column, mapping: Mapping | None, otherwise: Column) -> Column:
    """Only an exact value of the mapping overrides ``otherwise``."""
    return otherwise if mapping is None else F.coalesce(F.element_at(_map(mapping["values"]), raw), otherwise)


def column_for(category: str, mapping: Mapping, overrides: Mapping[str, str] | None = None) -> str:
    """The board column to write a category to; the default is never one."""
    if overrides and category in overrides:
        return overrides[category]
    found = sorted(k for k, c in mapping["values"].items() if c == category)
    if not found:
        raise Unmapped(category)
    if len(found) > 1:
        raise Ambiguous(f"{category}: {found}")
    return found[0]


def parse_category(name: str) -> str:
    wanted = name.replace("_", "").replace("-", "").lower()
    for c in CATEGORIES:
        if c.lower() == wanted:
            return c
    raise ValueError(f"unknown category {name!r}")


def priority_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), level) - 1


def provider_slug(provider: Column) -> Column:
    return F.coalesce(F.element_at(_map(SLUGS), provider), F.lower(provider))


def scoped_uid(uid: Column, scope: str | None = None) -> Column:
    return uid if scope is None else F.concat(F.lit(f"{scope}/"), uid)


def _actors(*groups: Column) -> Column:
    return F.concat(*groups)


def _null() -> Column:
    return F.lit(None).cast("string")


def _people(role: str, people: Column, handle: str) -> Column:
    kind = "array<struct<role: string, handle: string, display: string>>"
    made = F.transform(people, lambda p: F.struct(F.lit(role).alias("role"), p[handle].alias("handle"), _null().alias("display")))
    return F.coalesce(made.cast(kind), F.array().cast(kind))


def _person(role: str, who: Column, handle: Column, display: Column | None = None) -> Column:
    kind = "array<struct<role: string, handle: string, display: string>>"
    one = F.array(F.struct(F.lit(role).alias("role"), handle.alias("handle"), (_null() if display is None else display).alias("display")))
    return F.when(who.isNotNull(), one.cast(kind)).otherwise(F.array().cast(kind))


_CONTAINERS = "array<struct<kind: string, id: string, name: string, primary: boolean>>"


def _container(kind: str, id: Column, name: Column, primary: bool) -> Column:
    return F.struct(F.lit(kind).alias("kind"), id.alias("id"), name.alias("name"), F.lit(primary).alias("primary"))


def _ticket(provider: str, **given: Column) -> list[Column]:
    text = lambda c: F.coalesce(given[c], F.lit(""))
    strings = "array<string>"
    return [
        F.lit(provider).alias("provider"),
        given["uid"].cast("string").alias("uid"),
        given["display"].cast("string").alias("display"),
        given.get("item_type", F.lit("issue")).alias("item_type"),
        text("title").alias("title"),
        F.struct(given["category"].alias("category"), given.get("resolution", _null()).alias("resolution"), given["raw_name"].alias("raw_name"), given.get("raw_id", _null()).cast("string").alias("raw_id")).alias("state"),
        given.get("priority", F.lit(None)).cast("struct<level: string, raw: string>").alias("priority"),
        given["actors"].alias("actors"),
        F.coalesce(given["labels"], F.array()).cast(strings).alias("labels"),
        F.coalesce(given["containers"].cast(_CONTAINERS), F.array().cast(_CONTAINERS)).alias("containers"),
        F.array().cast("array<struct<kind: string, target: string>>").alias("links"),
        F.struct(text("markdown").alias("markdown"), given.get("format", F.lit("Markdown")).alias("format"), given.get("raw", _null()).alias("raw")).alias("body"),
        given.get("fields", _map({})).alias("fields"),
    ]


def github_issues(issues: DataFrame, repository: str) -> DataFrame:
    """Pull requests are no tickets."""
    c = F.col
    closed = c("state") == "closed"
    dropped = closed & (F.coalesce(c("state_reason"), F.lit("")) == "not_planned")
    number = F.concat(F.lit("#"), c("number").cast("string"))
    return issues.where(c("pull_request").isNull()).select(
        *_ticket(
            "GitHub",
            uid=F.concat(F.lit(repository), number),
            display=number,
            title=c("title"),
            category=F.when(dropped, "Canceled").when(closed, "Done").otherwise("Open"),
            resolution=F.when(dropped, "WontDo").when(closed, "Done"),
            raw_name=c("state"),
            raw_id=c("node_id"),
            actors=_actors(_people("Assignee", c("assignees"), "login"), _person("Submitter", c("user"), c("user.login"))),
            labels=c("labels.name"),
            containers=F.array(_container("repo", F.lit(repository), _null(), True)),
            markdown=c("body"),
            fields=F.create_map(F.lit("html_url"), F.to_json(F.array("html_url")).substr(F.lit(2), F.length(F.to_json(F.array("html_url"))) - 2)),
        )
    )


def github_project_items(items: DataFrame, mapping: Mapping) -> DataFrame:
    """Only issues that have a number and a repository are tickets."""
    c = F.col
    raw = F.coalesce(c("fieldValueByName.name"), F.lit(""))
    number = F.concat(F.lit("#"), c("content.number").cast("string"))
    repository = c("content.repository.nameWithOwner")
    issue = (c("content.__typename") == "Issue") & c("content.number").isNotNull() & repository.isNotNull()
    return items.where(issue).select(
        *_ticket(
            "GitHub",
            uid=F.concat(repository, number),
            display=number,
            title=c("content.title"),
            category=category_of(raw, mapping),
            raw_name=raw,
            raw_id=c("fieldValueByName.optionId"),
            actors=_actors(_people("Assignee", c("content.assignees.nodes"), "login"), _person("Submitter", c("content.author"), c("content.author.login"))),
            labels=c("content.labels.nodes.name"),
            containers=F.array(_container("repo", repository, _null(), True)),
            markdown=c("content.body"),
        )
    )


def _table(value: Column, pairs: Mapping[str, str], otherwise: Column) -> Column:
    return F.when(value.isNotNull(), F.coalesce(F.element_at(_map(pairs), F.lower(value)), otherwise))


JIRA_RESOLUTIONS = {"done": "Done", "fixed": "Done", "won't do": "WontDo", "wont do": "WontDo", "won't fix": "WontDo", "wontfix": "WontDo", "duplicate": "Duplicate", "cannot reproduce": "CannotReproduce", "cannot reproduce it": "CannotReproduce", "invalid": "Invalid"}
JIRA_PRIORITIES = {"highest": "Urgent", "critical": "Urgent", "blocker": "Urgent", "high": "High", "low": "Low", "lowest": "None", "trivial": "None"}


def jira_issues(issues: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """``fields.description`` is the rich document as JSON text."""
    f = lambda name: F.col(f"fields.{name}")
    own = F.coalesce(F.element_at(_map({"indeterminate": "InProgress", "done": "Done"}), f("status.statusCategory.key")), F.lit("Open"))
    who = lambda role, p: _person(role, f(p), F.coalesce(f(f"{p}.accountId"), f(f"{p}.displayName")), f(f"{p}.displayName"))
    return issues.select(
        *_ticket(
            "Jira",
            uid=F.col("key"),
            display=F.col("key"),
            item_type=F.coalesce(f("issuetype.name"), F.lit("issue")),
            title=f("summary"),
            category=exact_or(f("status.name"), mapping, own),
            resolution=_table(f("resolution.name"), JIRA_RESOLUTIONS, f("resolution.name")),
            raw_name=f("status.name"),
            raw_id=f("status.id"),
            priority=F.when(f("priority").isNotNull(), F.struct(_table(f("priority.name"), JIRA_PRIORITIES, F.lit("Medium")).alias("level"), f("priority.name").alias("raw"))),
            actors=_actors(who("Assignee", "assignee"), who("Submitter", "reporter")),
            labels=f("labels"),
            containers=F.when(f("project").isNotNull(), F.array(_container("project", f("project.key"), f("project.name"), True))),
            markdown=rich_text(f("description")),
            format=F.lit("Adf"),
            raw=f("description"),
            fields=F.create_map(F.lit("jira_id"), F.concat(F.lit('"'), F.col("id"), F.lit('"'))),
        )
    )


def linear_issues(issues: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    c = F.col
    own = F.coalesce(F.element_at(_map({"triage": "Triage", "backlog": "Backlog", "started": "InProgress", "completed": "Done", "canceled": "Canceled"}), c("state.type")), F.lit("Open"))
    level = F.coalesce(F.element_at(_map({"1": "Urgent", "2": "High", "3": "Medium", "4": "Low"}), c("priority").cast("string")), F.lit("None"))
    who = lambda role, p: _person(role, c(p), c(f"{p}.displayName"), c(f"{p}.displayName"))
    none = F.array().cast(_CONTAINERS)
    team = F.when(c("team").isNotNull(), F.array(_container("team", c("team.key"), c("team.name"), True)).cast(_CONTAINERS)).otherwise(none)
    project = F.when(c("project").isNotNull(), F.array(_container("project", c("project.name"), c("project.name"), False)).cast(_CONTAINERS)).otherwise(none)
    return issues.select(
        *_ticket(
            "Linear",
            uid=c("id"),
            display=c("identifier"),
            title=c("title"),
            category=exact_or(c("state.name"), mapping, own),
            raw_name=c("state.name"),
            priority=F.struct(level.alias("level"), c("priority").cast("string").alias("raw")),
            actors=_actors(who("Assignee", "assignee"), who("Submitter", "creator")),
            labels=c("labels.nodes.name"),
            containers=F.concat(team, project),
            markdown=c("description"),
        )
    )


def gitlab_issues(issues: DataFrame, project: str, mapping: Mapping | None = None) -> DataFrame:
    """A closed issue is done whatever its labels; else the first label with
    the mapping's prefix decides."""
    c = F.col
    category, raw = F.lit("Open"), c("state")
    signal = mapping and mapping.get("signal")
    if signal and signal[0] == "scoped_label":
        prefix = signal[1]
        label = F.get(F.filter(c("labels"), lambda x: x.startswith(prefix)), F.lit(0))
        category = F.when(label.isNotNull(), category_of(F.substr(label, F.lit(len(prefix) + 1)), mapping)).otherwise(category)
        raw = F.coalesce(label, raw)
    closed = c("state") == "closed"
    number = F.concat(F.lit("#"), c("iid").cast("string"))
    return issues.select(
        *_ticket(
            "GitLab",
            uid=F.coalesce(c("references.full"), F.concat(F.lit(project), number)),
            display=number,
            item_type=F.coalesce(c("issue_type"), F.lit("issue")),
            title=c("title"),
            category=F.when(closed, "Done").otherwise(category),
            raw_name=F.when(closed, c("state")).otherwise(raw),
            actors=_actors(_people("Assignee", c("assignees"), "username"), _person("Submitter", c("author"), c("author.username"))),
            labels=c("labels"),
            containers=F.array(_container("project", F.lit(project), _null(), True)),
            markdown=c("description"),
        )
    )


def asana_tasks(tasks: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """The first membership is primary, even if its project is unknown."""
    c = F.col
    signal = mapping and mapping.get("signal")
    signalled = _null()
    if signal == "completed":
        signalled = c("completed").cast("string")
    elif signal == "section":
        signalled = F.get(c("memberships"), F.lit(0))["section"]["name"]
    elif signal and signal[0] == "custom_field":
        own = F.get(F.filter(c("custom_fields"), lambda x: x["gid"] == signal[1]), F.lit(0))
        signalled = F.coalesce(own["enum_value"]["name"], own["display_value"])
    plain = F.when(c("completed"), "Done").otherwise("Open")
    category = F.when(signalled.isNotNull(), category_of(signalled, mapping)).otherwise(plain) if mapping else plain
    members = F.transform(c("memberships"), lambda m, i: F.when(m["project"].isNotNull(), F.struct(F.lit("project").alias("kind"), m["project"]["gid"].alias("id"), m["project"]["name"].alias("name"), (i == 0).alias("primary"))))
    url = F.when(c("permalink_url").isNotNull(), F.create_map(F.lit("permalink_url"), F.concat(F.lit('"'), c("permalink_url"), F.lit('"'))))
    return tasks.select(
        *_ticket(
            "Asana",
            uid=c("gid"),
            display=c("gid"),
            item_type=F.lit("task"),
            title=c("name"),
            category=category,
            raw_name=F.coalesce(signalled, F.when(c("completed"), "completed").otherwise("incomplete")),
            actors=_actors(_person("Assignee", c("assignee"), c("assignee.name")), _person("Submitter", c("created_by"), c("created_by.name"))),
            labels=c("tags.name"),
            containers=F.filter(members, lambda x: x.isNotNull()),
            markdown=c("notes"),
            format=F.when(c("html_notes").isNotNull(), "Html").otherwise("PlainText"),
            raw=c("html_notes"),
            fields=F.coalesce(url, _map({})),
        )
    )


CANCEL_WORDS = ("cancel", "won't do", "wont do", "will not do", "reject", "abandon", "discard")


def choose_transition(transitions: list[dict], target: str) -> dict | None:
    """The workflow step (``name``, ``category``) that leads to a category: of
    those in its status group, one whose name speaks of cancelling if and only
    if that is meant, else the first."""
    want = {"Done": "done", "Canceled": "done", "InProgress": "indeterminate", "Pending": "indeterminate"}.get(target, "new")
    found = [t for t in transitions if t["category"] == want]
    cancels = lambda t: any(w in t["name"].lower() for w in CANCEL_WORDS)
    liked = [t for t in found if target in ("Done", "Canceled") and cancels(t) == (target == "Canceled")]
    return (liked or found or [None])[0]


def violations(tickets: DataFrame) -> DataFrame:
    """``uid, problem`` of every ticket that breaks an invariant."""
    empty = lambda c, name: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{name} is empty"))
    primary = F.when(F.size(F.filter("containers", lambda x: x["primary"])) > 1, F.lit("more than one primary container"))
    problems = F.array_compact(F.array(empty("uid", "uid"), empty("display", "display"), empty("item_type", "item_type"), empty("state.raw_name", "raw_name"), primary))
    return tickets.select("uid", F.explode(problems).alias("problem"))
