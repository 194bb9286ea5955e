import collections
import random
import re

import pytest

from ledgerloom.llm.repeats import repeated_passages


def brute(rows, length):
    docs = [(i, re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) for i, t in rows]
    count = collections.Counter(tuple(w[k : k + length]) for _, w in docs for k in range(len(w) - length + 1))
    out = set()
    for i, w in docs:
        at = [k for k in range(len(w) - length + 1) if count[tuple(w[k : k + length])] > 1]
        while at:
            first = last = at.pop(0)
            while at and at[0] <= last + length:
                last = at.pop(0)
            out.add((i, first, last + length))
    return out


def corpus():
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 80, 130)]
    rows = []
    for i in range(60):
        body = text(rng.randrange(10, 200))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            at = rng.randrange(len(body))
            body = body[:at] + p[rng.randrange(3) :] + body[at:]
        rows.append((i, " ".join(body)))
    rows += [(100, " ".join(["same"] * 300)), (101, "a b " * 80), (102, rows[5][1]), (103, rows[5][1].upper()), (104, None), (105, ""), (106, "few words"), (107, " ".join(text(20_000))), (None, rows[7][1])]
    return rows


@pytest.mark.parametrize("length", [50, 7])
def test_matches_brute_force(docs, length):
    rows = corpus()
    got = [tuple(r) for r in repeated_passages(docs(rows), length).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, length)


def test_repeated_rows_and_empty(docs):
    text = " ".join(f"x{i}" for i in range(60))
    assert [tuple(r) for r in repeated_passages(docs([(1, text), (1, text)])).collect()] == [(1, 0, 60)]
    assert repeated_passages(docs([(1, text)])).collect() == []
    assert repeated_passages(docs([])).collect() == []
