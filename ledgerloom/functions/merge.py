"""Three-way merges of record bodies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GONE = object()
_OUTCOME = T.StructType([T.StructField("outcome", T.StringType()), T.StructField("body", T.BinaryType())])


def merge_append_only(ours: bytes, theirs: bytes) -> bytes:
    """``ours``, then the lines of ``theirs`` after their common first lines."""
    mine, other = ours.split(b"\n"), theirs.split(b"\n")
    mine = mine[:-1] if mine[-1] == b"" else mine
    ends_open = bool(other[-1])
    other = other if ends_open else other[:-1]
    same = 0
    while same < min(len(mine), len(other)) and mine[same] == other[same]:
        same += 1
    tail = other[same:]
    if not tail:
        return ours
    joint = b"\n" if ours and not ours.endswith(b"\n") else b""
    return ours + joint + b"\n".join(tail) + (b"" if ends_open else b"\n")


def _equal(a: object, b: object) -> bool:
    """Equality that tells 1 from 1.0 and from true."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    return a == b


class Conflict(Exception):
    pass


def merge_json(base: object, ours: object, theirs: object) -> object:
    """Field by field where all three are objects; the side that changed wins.
    An absent field is a value of its own, so deletions count as changes."""
    for same, take in (((ours, theirs), ours), ((ours, base), theirs), ((theirs, base), ours)):
        if _equal(*same):
            return take
    if not all(isinstance(x, dict) for x in (base, ours, theirs)):
        raise Conflict
    fields = ((k, merge_json(*(x.get(k, _GONE) for x in (base, ours, theirs)))) for k in sorted({*base, *ours, *theirs}))
    return {k: v for k, v in fields if v is not _GONE}


def merge_structured(base: bytes, ours: bytes, theirs: bytes) -> bytes | None:
    """The merged JSON with sorted keys, None if it needs a human."""
    try:
        merged = merge_json(*(json.loads(x) for x in (base, ours, theirs)))
    except (Conflict, ValueError):
        return None
    return json.dumps(merged, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def merge_appended_json(base: bytes, ours: bytes, theirs: bytes) -> bytes | None:
    """An append to JSON objects: arrays that share a beginning are continued,
    everything else is merged as ``merge_structured`` does."""

    def join(b: object, o: object, t: object) -> object:
        if isinstance(o, list) and isinstance(t, list):
            same = 0
            while same < min(len(o), len(t)) and _equal(o[same], t[same]):
                same += 1
            return o + t[same:]
        if isinstance(o, dict) and isinstance(t, dict):
            start = b if isinstance(b, dict) else {}
            fields = {k: join(start.get(k, _GONE), o.get(k, _GONE), t.get(k, _GONE)) for k in sorted({*o, *t})}
            return {k: v for k, v in fields.items() if v is not _GONE}
        if o is _GONE or t is _GONE:
            return t if o is _GONE else o
        return merge_json(b, o, t)

    try:
        mine, other = json.loads(ours), json.loads(theirs)
        start = json.loads(base) if base else _GONE
        merged = join(start, mine, other)
    except (Conflict, ValueError):
        return None
    return json.dumps(merged, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def _merge_bodies(kind: pd.Series, base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
    outcome, body = [], []
    for k, b, o, t in zip(kind, base, ours, theirs):
        o, t = bytes(o or b""), bytes(t or b"")
        if k == "append_only":
            made = merge_append_only(o, t)
        elif k == "structured":
            made = merge_structured(bytes(b or b""), o, t)
        else:
            made = o if k == "derived" else None
        outcome.append("conflict" if made is None else "merged")
        body.append(made)
    return pd.DataFrame({"outcome": outcome, "body": pd.Series(body, dtype=object)})


def merge_bodies(kind: Column, base: Column | str, ours: Column | str, theirs: Column | str) -> Column:
    """By merge class: ``merged`` with the body, or ``conflict`` without.  A
    missing base is an empty one."""
    return F.pandas_udf(_merge_bodies, _OUTCOME)(kind, base, ours, theirs)
