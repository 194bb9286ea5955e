"""Toxicity: gradient-boosted trees over dense features, calibrated.

Per text: densities of a lexicon (plain, and after undoing look-alike
characters), the densest stretch, closeness of second-person words, capitals,
punctuation and obfuscation rates.  The lexicon is a list of insults and the
words and word stems that the labelled rows show to be toxic beyond chance.
Boosted trees on the features give a score that an isotonic fit on held-out
rows turns into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import plain, table
from ._tokens import Block, Words, lowered, raw_blocks, words_of

#: At most so many labelled rows are used for fitting.
MAX_TRAIN = 12000
#: Words within which a second-person word counts as close, and the length of
#: the stretch of which the densest counts.
NEAR, STRETCH = 6, 40

LEXICON = """
idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools foolish loser losers pathetic
worthless useless trash garbage scum scumbag filth filthy vermin disgusting disgrace clown clowns jerk creep pervert
bastard bitch asshole shit fuck fucking crap damn hate hateful kill die ugly fat pig pigs rat rats liar liars coward
cowards imbecile cretin retard retarded lunatic psycho freak freaks sicko degenerate parasite braindead
dummkopf idioten arschloch scheisse scheiße dreck abschaum wertlos dumm hässlich
imbécile crétin connard salope merde ordure abruti débile racaille dégueulasse
idiota idiotas estúpido estúpida imbécil basura asco mierda cabrón puta escoria inútil
""".split()
SECOND_PERSON = "you your yours yourself yourselves ur u youre du dich dir dein deine euch ihr tu te toi ton ta vous votre tú usted ustedes vosotros".split()

#: Bytes of a stem: the beginning of any longer word.
STEM = 5
#: Every so many rows of the sample are held out: neither mined nor boosted on.
HOLD_OUT = 4

FEATURES = ("lexicon", "lexicon_count", "lexicon_kinds", "densest", "undone", "undone_count", "second_person", "near_second_person", "capitals", "shouted_words", "exclamations", "punctuation", "repeated_punctuation", "digits_in_words", "symbols_in_words", "log_words", "stems", "stem_count")


def _hashes(terms: list[str]) -> np.ndarray:
    column = pa.array(sorted(set(terms)))
    return np.unique(np.concatenate([words_of(Block(b.first, lowered(b.data), b.offsets)).hash for b in raw_blocks(column)]))


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for a, b in ranges:
        out[a:b] = 1
    return out


_UPPER, _LETTER = _table((65, 91)), _table((65, 91), (97, 123), (128, 256))
_PUNCT = _table((33, 48), (58, 65), (91, 97), (123, 127))
_LOUD = np.zeros(256, np.uint8)
_LOUD[[33, 63]] = 1
_DIGIT = _table((48, 58))
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "@$*#!|+"]] = 1
_UNDO = np.arange(256, dtype=np.uint8)
for a, b in zip("013457@$!|+", "oieastasiit"):
    _UNDO[ord(a)] = ord(b)


def _sum(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[edges[1:]] - total[edges[:-1]]).astype(float)


@dataclass
class Lexicon:
    """Sorted hashes of words, of second-person words and stems as numbers."""

    words: np.ndarray
    second: np.ndarray
    stems: np.ndarray


def _stems_of(low: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(stem, text) of every word of more than ``STEM`` bytes."""
    at = np.flatnonzero(words.end - words.start > STEM)
    stem = np.zeros(len(at), np.uint64)
    for k in range(STEM):
        stem |= low[words.start[at] + k].astype(np.uint64) << np.uint64(8 * k)
    return stem, words.text[at]


def _among(values: np.ndarray, terms: np.ndarray) -> np.ndarray:
    if not len(values) or not len(terms):
        return np.zeros(len(values), bool)
    return terms[np.minimum(np.searchsorted(terms, values), len(terms) - 1)] == values


def dense_features(block: Block, lexicon: Lexicon) -> np.ndarray:
    """A row of ``FEATURES`` per text; ``block`` holds the texts unchanged."""
    data, offsets, n = block.data, block.offsets, block.texts
    low = lowered(data)
    words = words_of(Block(block.first, low, offsets))
    count = np.diff(words.first_word)
    per_word, chars = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)

    hit, you = _among(words.hash, lexicon.words), _among(words.hash, lexicon.second)
    hits, yous = _sum(hit, words.first_word), _sum(you, words.first_word)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0], out[:, 1] = hits / per_word, hits
    where = np.flatnonzero(hit)
    if len(where):
        text = words.text[where]
        pair = np.unique(np.column_stack((text, (words.hash[where] >> np.uint64(1)).astype(np.int64))), axis=0)
        out[:, 2] = np.bincount(pair[:, 0], minlength=n)
        # the densest stretch that begins at a hit
        last = np.searchsorted(where, where + STRETCH)
        last = np.minimum(last, np.searchsorted(text, text, side="right"))
        np.maximum.at(out[:, 3], text, (last - np.arange(len(where))) / np.minimum(STRETCH, per_word[text]))
        sums = np.concatenate(([0], np.cumsum(you)))
        a = np.maximum(where - NEAR, words.first_word[text])
        b = np.minimum(where + NEAR + 1, words.first_word[text + 1])
        out[:, 7] = np.bincount(text, sums[b] > sums[a], minlength=n)
    undone = words_of(Block(block.first, _UNDO[low], offsets))
    again = _sum(_among(undone.hash, lexicon.words), undone.first_word)
    out[:, 5] = np.maximum(again - hits, 0)
    out[:, 4] = out[:, 5] / per_word
    out[:, 6] = yous / per_word
    upper, letter, punct = _UPPER[data], _LETTER[data], _PUNCT[data]
    out[:, 8] = _sum(upper, offsets) / np.maximum(_sum(letter, offsets), 1)
    if len(words.start):
        ups = np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))
        length = words.end - words.start
        shouted = (ups[words.end] - ups[words.start] == length) & (length > 1)
        out[:, 9] = _sum(shouted, words.first_word) / per_word
    out[:, 10] = _sum(_LOUD[data], offsets) / chars
    out[:, 11] = _sum(punct, offsets) / chars
    if len(data) > 2:
        # neighbours count within a text only
        some = np.flatnonzero(np.diff(offsets))
        first, last = offsets[some], offsets[some + 1] - 1
        same = np.zeros(len(data), np.uint8)
        same[1:] = punct[1:] & (data[1:] == data[:-1])
        same[first] = 0
        out[:, 12] = _sum(same, offsets) / chars
        for column, table in ((13, _DIGIT), (14, _SYMBOL)):
            flags = np.zeros(len(data), np.uint8)
            flags[1:-1] = table[data[1:-1]] & letter[:-2] & letter[2:]
            flags[first] = flags[last] = 0
            out[:, column] = _sum(flags, offsets) / per_word
    out[:, 15] = np.log1p(count)
    stem, text = _stems_of(low, words)
    out[:, 17] = np.bincount(text[_among(stem, lexicon.stems)], minlength=n)
    out[:, 16] = out[:, 17] / per_word
    return out


@dataclass
class Tree:
    feature: np.ndarray  # of inner nodes in heap order, -1 for none
    cut: np.ndarray
    leaf: np.ndarray


@dataclass
class ToxicityModel:
    base: float
    depth: int
    lexicon: Lexicon | None = None
    trees: list[Tree] = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = tree.feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > tree.cut[node]))
            out += tree.leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: linear between the knots of the isotonic fit."""
        return np.interp(self.margin(x), self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: (knots, levels), ascending.  Equal ``x``
    are one point first."""
    points, back = np.unique(x, return_inverse=True)
    weight = np.bincount(back).astype(float)
    level = np.bincount(back, y) / weight
    stack: list[list[float]] = []
    for p, v, w in zip(points, level, weight):
        stack.append([v, w, p, p])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            v2, w2, _, b2 = stack.pop()
            v1, w1, a1, _ = stack[-1]
            stack[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, a1, b2]
    knots = np.array([e for v, w, a, b in stack for e in ((a, b) if b > a else (a,))])
    levels = np.array([v for v, w, a, b in stack for _ in ((a, b) if b > a else (a,))])
    return knots, levels


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> ToxicityModel:
    """Newton boosting of the logistic loss on histograms; the ``held`` rows
    calibrate.  With one class only, or no rows, the model is constant."""
    if len(y) < 8 or y.min() == y.max():
        rate_of = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(0.0, depth, None, [], np.array([0.0]), np.array([rate_of]))
    if held.all() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    xt, yt = x[~held], y[~held]
    cuts = [np.unique(np.quantile(xt[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    # a rare non-zero value must be separable from zero
    cuts = [np.unique(np.concatenate(([0.0] if (xt[:, f] > 0).any() else [], c))) for f, c in enumerate(cuts)]
    binned = np.column_stack([np.searchsorted(c, xt[:, f], side="left") for f, c in enumerate(cuts)])
    p = np.clip(yt.mean(), 1e-4, 1 - 1e-4)
    model = ToxicityModel(float(np.log(p / (1 - p))), depth)
    margin = np.full(len(yt), model.base)
    width = bins + 2
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - yt, np.maximum(q * (1 - q), 1e-6)
        inner = 2**depth - 1
        tree = Tree(np.full(inner, -1), np.zeros(inner), np.zeros(2**depth))
        node = np.zeros(len(yt), np.int64)
        for level in range(depth):
            lo = 2**level - 1
            here = node - lo
            best = np.full(2**level, 1e-6)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = here * width + binned[:, f]
                gs = np.bincount(key, g, 2**level * width).reshape(-1, width).cumsum(1)
                hs = np.bincount(key, h, 2**level * width).reshape(-1, width).cumsum(1)
                gl, hl = gs[:, : len(c)], hs[:, : len(c)]
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                at = gain.argmax(1)
                value = gain[np.arange(len(gain)), at]
                for k in np.flatnonzero(value > best):
                    best[k], tree.feature[lo + k], tree.cut[lo + k] = value[k], f, c[at[k]]
            f = tree.feature[node]
            node = 2 * node + 1 + ((f >= 0) & (xt[np.arange(len(xt)), np.maximum(f, 0)] > tree.cut[node]))
        leaf = node - inner
        tree.leaf = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        margin += tree.leaf[leaf]
        model.trees.append(tree)
    on = held if held.any() else ~held
    model.knots, model.levels = isotonic(model.margin(x[on]), y[on].astype(float))
    return model


def _rows(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    parts = [dense_features(block, lexicon) for block in raw_blocks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many toxic and other texts each word and stem is."""
    keys: list[np.ndarray] = [np.empty((0, 2), np.int64)]
    toxic: list[np.ndarray] = [np.empty(0)]
    for b in batches:
        y = b.column(0).to_numpy(zero_copy_only=False) > 0.5
        for block in raw_blocks(b.column(1)):
            low = lowered(block.data)
            words = words_of(Block(block.first, low, block.offsets))
            stem, of = _stems_of(low, words)
            for kind, value, text in ((0, words.hash, words.text), (1, stem, of)):
                pair = np.unique(np.column_stack((text, value.view(np.int64))), axis=0)
                keys.append(np.column_stack((np.full(len(pair), kind), pair[:, 1])))
                toxic.append(y[block.first + pair[:, 0]])
    key, back = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
    n = np.bincount(back.ravel(), minlength=len(key))
    t = np.bincount(back.ravel(), np.concatenate(toxic), minlength=len(key)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(key[:, 0].astype(np.int32)), pa.array(key[:, 1]), pa.array(t), pa.array(n)], names=["kind", "term", "toxic", "n"])


def mine(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and stems that are in toxic texts beyond chance.

    ``sample`` has ``y, text``.  A term counts once a text, equal texts count
    once.  It is taken if the evidence against independence, n KL(share of
    toxic || overall share), exceeds the log of the number of terms by 4, and
    at least four in five of its texts are toxic.  Terms of fewer than 3 toxic
    texts are not considered.
    """
    once = sample.groupBy(F.xxhash64("text")).agg(F.max("y").alias("y"), F.first("text").alias("text")).select("y", "text")
    base = once.agg(F.avg(F.when(F.col("y") > 0.5, 1.0).otherwise(0.0))).first()[0]
    if not base or base >= 1:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    counts = once.mapInArrow(_count_terms, "kind int, term long, toxic long, n long").groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    share = F.col("toxic") / F.col("n")
    rest = F.when(share < 1, (F.col("n") - F.col("toxic")) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = F.col("toxic") * F.log(share / base) + rest
    counts = table(counts.where("toxic >= 3"), "toxicity-terms")
    found = counts.where(share >= 0.8).select("kind", "term", evidence.alias("evidence")).where(F.col("evidence") > 4 + float(np.log(max(1, counts.count())))).toPandas()
    part = lambda k: np.unique(found.term[found.kind == k].to_numpy(np.int64).view(np.uint64))
    return part(0), part(1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lexicon: list[str] = LEXICON, second_person: list[str] = SECOND_PERSON, max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Fit on the first ``max_train`` labelled rows in the order of a hash of
    the id, so that the share of toxic rows is that of the labels.

    Labels without an id, a flag or a text are passed over; a doc labelled
    more than once counts each time.
    """
    docs, (i, t) = plain(docs, id_col, text_col)
    labels, (k, flag) = plain(labels, id_col, label_col)
    known = labels.select(F.col(k).cast("long").alias("doc_id"), F.col(flag).cast("double").alias("y")).dropna()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_train)
    texts = docs.select(F.col(i).cast("long").alias("doc_id"), F.col(t).alias("text")).where(F.col("text").isNotNull())
    # the sample is bounded by max_train, so it may always be broadcast
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held")), F.lit(HOLD_OUT)) == 0
    rows = table(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "y", held.alias("held"), "text"), "toxicity-sample")
    words, stems = mine(rows.where(~F.col("held")).select("y", "text"))
    terms = Lexicon(np.union1d(_hashes(lexicon), words), _hashes(second_person), stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column(3), terms)
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), flat], names=["doc_id", "y", "held", "x"])

    got = rows.mapInArrow(run, "doc_id long, y double, held boolean, x array<double>").toArrow()
    y = got.column("y").to_numpy() > 0.5
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((x[:, 15], got.column("doc_id").to_numpy())) if len(y) else np.empty(0, np.int64)
    model = fit(x[order], y[order].astype(float), got.column("held").to_numpy(zero_copy_only=False)[order].astype(bool))
    model.lexicon = terms
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, toxicity``: the calibrated probability of every row.

    A null text counts as empty, and an empty one has all features zero.
    Equal texts get equal results; repeated rows are scored each; ids may be
    null.  Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    safe, (i, t) = plain(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.probability(_rows(b.column(1), shared.value.lexicon))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "toxicity"])

    return safe.select(F.col(i).cast("long").alias("doc_id"), F.col(t).alias("text")).mapInArrow(run, "doc_id long, toxicity double")
