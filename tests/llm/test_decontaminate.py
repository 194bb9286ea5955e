import math
import random
import re

import pytest

from ledgerloom.llm.decontaminate import contaminated, decontaminate

N, T = 5, 0.7


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def shingles(w, n=N):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def brute(rows, items):
    out = set()
    for i, t in rows:
        for j, x in items:
            w = words(x)
            n = min(N, len(w))
            if not w:
                continue
            own, d = set(shingles(w, n)), shingles(words(t), n)
            if not d:
                continue
            reach = len(w) - n + 1
            best = max(len(own & set(d[k : k + reach])) for k in range(len(d)))
            if best >= math.ceil(len(own) * T - 1e-9):
                out.add((i, j, best, len(own)))
    return out


def corpus():
    rng = random.Random(12)
    text = lambda n: [f"v{rng.randrange(150)}" for _ in range(n)]
    items = [(j, " ".join(text(rng.choice((3, 5, 8, 20, 40))))) for j in range(25)] + [(90, None), (91, ""), (92, "one two"), (93, "a b a b a b a b a b")]
    rows = []
    for i in range(60):
        body = text(rng.randrange(1, 120))
        if i % 2:
            w = words(rng.choice(items[:25])[1])
            w = [x if rng.random() > 0.05 else "changed" for x in w]
            at = rng.randrange(len(body))
            body = body[:at] + w + body[at:]
        rows.append((i, " ".join(body)))
    return rows + [(100, None), (101, ""), (102, "One, two!"), (103, "a b " * 9), (104, " ".join(text(9000)) + " " + items[4][1]), (105, "says one two words more and the tiny answer too"), (106, "ЕЩЁ РАЗ: ΤΡΙΑ μήλα"), (None, items[5][1])], [*items, (94, "The tiny answer"), (95, "ещё раз"), (96, "τρια ΜΉΛΑ"), (97, "two")]


@pytest.mark.parametrize("filter_bytes", [1 << 21, 8])
def test_matches_brute_force(spark, docs, filter_bytes):
    rows, items = corpus()
    bench = spark.createDataFrame([(*x, "p", 1) for x in items], "item_id long, text string, shingle string, pos int")
    got = [(r["doc_id"], r["item_id"], r["found"], r["shingles"]) for r in contaminated(docs(rows), bench, filter_bytes=filter_bytes).collect()]
    assert len(got) == len(set(got))
    want = brute(rows, items)
    assert set(got) == want and len(want) > 10
    assert {(105, 94, 1, 1), (105, 92, 1, 1), (106, 95, 1, 1), (106, 96, 1, 1), (102, 97, 1, 1)} <= want
    left = decontaminate(docs(rows), bench)
    assert left.columns == docs(rows).columns
    bad = {w[0] for w in want}
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted((i for i, _ in rows if i not in bad), key=repr)


def test_repeated_rows_and_empty(spark, docs):
    bench = spark.createDataFrame([(1, "p q r s t u")], "item_id long, text string")
    none = bench.where("false")
    rows = [(1, "x p q r s t u y"), (1, "x p q r s t u y"), (1, "clean")]
    assert [tuple(r)[:1] for r in contaminated(docs(rows), bench).select("doc_id", "found").collect()] == [(1,)]
    assert [r["text"] for r in decontaminate(docs(rows), bench).collect()] == ["clean"]
    assert decontaminate(docs(rows), none).count() == 3
    assert contaminated(docs([]), bench).collect() == contaminated(docs(rows), none).collect() == []
    assert decontaminate(docs([]), bench).collect() == []


def test_items_without_an_id_and_ties(spark, docs):
    bench = spark.createDataFrame([(None, "p q r s t u"), (3, "p q r s t u"), (3, "p q r s t u v"), (3, None)], "item_id long, text string")
    got = contaminated(docs([(None, "x p q r s t u y"), (2, "p q r s t u v")]), bench).select("doc_id", "item_id", "found", "shingles").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, None, 2, 2), (None, 3, 2, 2), (2, None, 2, 2), (2, 3, 3, 3)], key=repr)
