import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import queries, toxicity
from ledgerloom.llm._tokens import Block, raw_blocks, words_of


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(max(2, len(body) // 8)):
                body.insert(rng.randrange(len(body)), rng.choice(["you idiot", "YOU M0R0N", "you pathetic", "st@pid you", "worthless trash"]))
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    known = spark.createDataFrame(labels[:450], "doc_id long, toxic int")
    model = toxicity.train(docs(rows), known)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs(rows), model).collect()}
    held = labels[450:]
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in held]) >= 0.95
    assert all(0 <= p <= 1 for p in got.values())


def test_isotonic_is_monotone_and_pools():
    x, y = np.array([1, 2, 3, 4, 4.0]), np.array([0, 1, 0, 1, 1.0])
    knots, levels = toxicity.isotonic(x, y)
    assert (np.diff(levels) >= 0).all()
    assert np.interp([1, 2, 3, 4], knots, levels).tolist() == [0, 0.5, 0.5, 1]


def test_features_see_obfuscation():
    lexicon = toxicity.Lexicon(toxicity._hashes(toxicity.LEXICON), toxicity._hashes(toxicity.SECOND_PERSON), np.empty(0, np.uint64))
    (block,) = raw_blocks(pa.array(["you 1diot", "you idiot", "nice day", "", "SHOUT!!"]))
    f = dict(zip(toxicity.FEATURES, toxicity.dense_features(block, lexicon).T))
    assert f["undone_count"].tolist() == [1, 0, 0, 0, 0] and f["lexicon_count"].tolist() == [0, 1, 0, 0, 0]
    assert f["near_second_person"][1] == 1 and f["shouted_words"][4] == 1 and f["repeated_punctuation"][4] > 0
    assert all(v[3] == 0 for v in f.values())


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (None, 1), (2, None)]])
def test_degenerate_labels(spark, docs, labels):
    rows = [(1, "you idiot"), (2, None), (None, ""), (2, "x " * 50_000), (2, "x " * 50_000)]
    model = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r["toxicity"] <= 1 for r in got)
    assert toxicity.score(docs([]), model).collect() == []


def plain_features(text, lexicon):
    """One text's features, character by character."""
    data = (text or "").encode()
    low = data.lower().decode().translate({ord(c): c.lower() for c in "ÀÉÖÜß"}).encode()
    found = lambda raw: list(re.finditer(rb"[0-9a-zA-Z\x80-\xff]+", raw))
    one = lambda w: int(words_of(Block(0, np.frombuffer(w, np.uint8), np.array([0, len(w)]))).hash[0])
    words = found(low)
    n, chars = max(1, len(words)), max(1, len(data))
    terms, second = set(lexicon.words.tolist()), set(lexicon.second.tolist())
    hit = [one(w[0]) in terms for w in words]
    you = [one(w[0]) in second for w in words]
    at = [k for k, h in enumerate(hit) if h]
    undo = bytes(dict(zip(b"013457@$!|+", b"oieastasiit")).get(b, b) for b in low)
    again = sum(one(w[0]) in terms for w in found(undo))
    letter = [65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in data]
    upper = [65 <= b < 91 for b in data]
    punct = [33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in data]
    between = lambda kinds: sum(data[k] in kinds and letter[k - 1] and letter[k + 1] for k in range(1, len(data) - 1))
    stems = sum(int.from_bytes(w[0][: toxicity.STEM], "little") in set(lexicon.stems.tolist()) for w in words if len(w[0]) > toxicity.STEM)
    return [
        sum(hit) / n,
        sum(hit),
        len({words[k][0] for k in at}),
        max((sum(k <= x < k + toxicity.STRETCH for x in at) / min(toxicity.STRETCH, n) for k in at), default=0),
        max(again - sum(hit), 0) / n,
        max(again - sum(hit), 0),
        sum(you) / n,
        sum(any(you[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k in at),
        sum(upper) / max(1, sum(letter)),
        sum(w.end() - w.start() > 1 and all(upper[w.start() : w.end()]) for w in words) / n,
        sum(b in b"!?" for b in data) / chars,
        sum(punct) / chars,
        sum(punct[k] and data[k] == data[k - 1] for k in range(1, len(data))) / chars,
        between(b"0123456789") / n,
        between(b"@$*#!|+") / n,
        math.log1p(len(words)),
        stems / n,
        stems,
    ]


TEXTS = ["you idiot!!", "", "st@pid y0u m0ron", "ALL CAPS you", "Dreck und Abschaum, DU!", "a1b c*d e", "nice " * 60 + "idiot moron trash", "lovely weather??", "x"]


@pytest.mark.parametrize("together", [True, False])
def test_features_match_plain_python(together):
    lexicon = toxicity.Lexicon(toxicity._hashes(toxicity.LEXICON), toxicity._hashes(toxicity.SECOND_PERSON), np.array([int.from_bytes(b"lovel", "little")], np.uint64))
    got = toxicity._rows(pa.array(TEXTS), lexicon) if together else np.concatenate([toxicity._rows(pa.array([t]), lexicon) for t in TEXTS])
    assert np.abs(got - np.array([plain_features(t, lexicon) for t in TEXTS])).max() < 1e-9


def plain_tree(x, g, h, cuts, depth, l2=1.0):
    """A tree as nested tuples by trying every cut on every row."""
    if not depth:
        return -0.2 * g.sum() / (h.sum() + l2)
    best = (1e-6, None)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    for f, c in enumerate(cuts):
        for cut in c:
            left = x[:, f] <= cut
            if h[left].sum() >= 0.5 and h[~left].sum() >= 0.5:
                value = gain(left) + gain(~left) - gain(np.ones(len(g), bool))
                if value > best[0] * (1 + 1e-9):
                    best = (value, (f, cut))
    if best[1] is None:
        below = plain_tree(x, g, h, cuts, depth - 1)
        return below
    left = x[:, best[1][0]] <= best[1][1]
    return (*best[1], plain_tree(x[left], g[left], h[left], cuts, depth - 1), plain_tree(x[~left], g[~left], h[~left], cuts, depth - 1))


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_boosting_matches_trying_every_cut():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=160)) > 0.4).astype(float)
    model = toxicity.fit(x, y, np.zeros(160, bool), trees=4, depth=2, bins=8)
    cuts = [np.unique(np.concatenate(([0.0], np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1])))) for f in range(3)]
    margin = np.full(160, math.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        q = 1 / (1 + np.exp(-margin))
        tree = plain_tree(x, q - y, np.maximum(q * (1 - q), 1e-6), cuts, 2)
        margin = margin + [walk(tree, r) for r in x]
    assert np.abs(model.margin(x) - margin).max() < 1e-9


def test_query_matches_plain_python(spark, tmp_path):
    """The registered query: features, trees and calibration by hand."""
    rows, labels = corpus(300)
    rows += [(900, None), (901, ""), (902, rows[1][1]), (903, "YOU IDIOT " * 4000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = {}
    for i, t in rows:
        x = plain_features(t, model.lexicon)
        m = model.base
        for tree in model.trees:
            node = 0
            for _ in range(model.depth):
                f = tree.feature[node]
                node = 2 * node + 1 + int(f >= 0 and x[f] > tree.cut[node])
            m += tree.leaf[node - (2**model.depth - 1)]
        p = float(np.interp(m, model.knots, model.levels))
        if p >= 0.5:
            want[i] = p
    got = {r["doc_id"]: r["toxicity"] for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
