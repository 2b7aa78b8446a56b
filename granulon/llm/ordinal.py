"""Ordinal regression with cumulative links on hashed text.

A text's score s is one sum of weights of its hashed features; grades 0 < 1 < ... < K share it and
differ by ordered thresholds: P(grade >= k) = sigmoid(s - t[k]). So what pulls a text from good to
middling also counts against it being bad, and few labels of the outer grades suffice. The expected
grade is the sum of these tail probabilities; texts are selected by the tail probability of a grade.

The model is fitted on FIT labelled rows at most, chosen by hash of their ids. Most words of a text say
nothing about its grade, and thousands of such weights would learn the sample by heart. So only features
have a weight whose texts pass some grade more or less often than chance explains.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import Recent, filter_rows, map_rows, text_of

#: Labelled rows fitted on at most; hashed features; texts that a feature must occur in to have a weight,
#: and standard errors that the share of its texts that pass a grade must be off.
FIT, FEATURES, LEAST_TEXTS, LEAST_Z = 8192, 1 << 18, 5, 4.5
STEPS, RATE, RIDGE = 400, 0.1, 3e-5
#: Lengths in bytes of the beginnings of words that are features, of texts where they make up this share of the words.
BEGINNINGS, LEAST_RATE = (4, 5, 6, 7, 8), 0.008
#: Words of which a worker keeps the weights.
MAX_WORDS = 300_000
#: A text is selected if its tail probability of the selecting grade is at least this.
LEAST_TAIL = 0.5

_SPACES = bytes(32 if chr(b) in " \t\n\v\f\r.,;:!?\"'()[]{}<>|#*$%&=+-/_~^@`\\" else b for b in range(256))
_MARKS = b"#*$%&<>|!="


def _words(data: bytes) -> Counter[bytes]:
    return Counter(data.lower().translate(_SPACES).split())


def _parts(word: bytes) -> list[bytes]:
    """A word and its beginnings; a beginning stands for the words of a family."""
    return [word, *(b"\0p" + word[:k] for k in BEGINNINGS if k <= len(word))]


def _shape(data: bytes) -> list[bytes]:
    """Features of the form of a text: its length, and how often each mark occurs, by orders of size."""
    size = max(1, len(data))
    out = [b"\0n%d" % int(math.log2(size))]
    for mark in _MARKS:
        k = data.count(mark)
        if k:
            out.append(b"\0m%c%d" % (mark, int(math.log2(1 + 1000 * k / size))))
    upper = size - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    out.append(b"\0u%d" % int(8 * upper / size))
    return out


def _slot(feature: bytes) -> int:
    return zlib.crc32(feature) & (FEATURES - 1)


def features(text: str) -> np.ndarray:
    """The different hashed features of a text, ascending: its words, its frequent beginnings, its shape."""
    data = text.encode()
    words = _words(data)
    often: Counter[bytes] = Counter()
    for word, n in words.items():
        for part in _parts(word)[1:]:
            often[part] += n
    least = LEAST_RATE * sum(words.values())
    frequent = [part for part, n in often.items() if n >= least]
    return np.unique(np.fromiter(map(_slot, [*words, *frequent, *_shape(data)]), np.int32))


class OrdinalModel:
    """Weights of hashed features and ordered thresholds of the grades 1 to K."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to K, by columns; never rising from left to right."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores[:, None], -60, 60)))


def fit_arrays(rows: list[np.ndarray], grades: np.ndarray, top: int) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam on all rows; the thresholds are a first one and positive gaps."""
    weights, thresholds = np.zeros(FEATURES), np.arange(top, dtype=float)
    if not len(rows):
        return OrdinalModel(weights, thresholds)
    sizes = np.array([len(r) for r in rows])
    columns = np.concatenate(rows)
    texts = np.bincount(columns, minlength=FEATURES)
    telling = np.zeros(FEATURES, bool)
    for k in range(1, top + 1):
        # Of the texts that reach grade k - 1: is the share of those that reach k another one with the feature?
        reach = grades >= k - 1
        n, above = reach.sum(), (grades >= k).astype(float)
        if not n:
            continue
        inside = np.repeat(reach, sizes)
        own = np.bincount(columns[inside], minlength=FEATURES)
        off = np.bincount(columns[inside], np.repeat(above - above[reach].mean(), sizes)[inside], FEATURES)
        telling |= np.abs(off) > LEAST_Z * above[reach].std() * np.sqrt(own * (1 - own / (n + 1)))
    used = np.flatnonzero((texts >= LEAST_TEXTS) & telling)
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))
    owner, columns = np.repeat(np.arange(len(rows)), sizes), place[columns]
    owner, columns = owner[columns >= 0], columns[columns >= 0]
    each = np.full(len(rows), 1 / len(rows))
    # The first threshold, the logarithms of the gaps, then the weights.
    x = np.concatenate([[-1.0], np.zeros(top - 1), np.zeros(len(used))])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        gaps = np.exp(x[1:top])
        t = x[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(owner, x[top:][columns], len(rows))
        tail = 1 / (1 + np.exp(np.clip(t - s[:, None], -60, 60)))
        edge = np.hstack([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))])
        slope = edge * (1 - edge)
        every = np.arange(len(rows))
        p = np.maximum(edge[every, grades] - edge[every, grades + 1], 1e-12)
        d_low, d_high = each * slope[every, grades] / p, each * slope[every, grades + 1] / p  # of t[grade], t[grade + 1]
        d_t = np.bincount(grades, d_low, top + 1)[1:] - np.bincount(grades + 1, d_high, top + 2)[1 : top + 1]
        d_s = -(d_low - d_high)
        grad = np.concatenate([[d_t.sum()], gaps * d_t[::-1].cumsum()[::-1][1:], np.bincount(columns, d_s[owner], len(used)) + RIDGE * x[top:]])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        x -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[used] = x[top:]
    return OrdinalModel(weights, x[0] + np.concatenate([[0.0], np.cumsum(np.exp(x[1:top]))]))


def scorer(model: OrdinalModel) -> Callable[[list[str]], np.ndarray]:
    """Scores of texts: the sum of the weights of features(text), by way of the few that have one."""
    weights = model.weights.astype(float)

    def weighted(word: bytes) -> tuple[int, tuple[int, ...]]:
        """The slot of a word, or -1, and the slots of its beginnings, where they have weights."""
        own, *rest = map(_slot, _parts(word))
        return own if weights[own] else -1, tuple(k for k in rest if weights[k])

    known = Recent(weighted, MAX_WORDS)

    def score(texts: list[str]) -> np.ndarray:
        out = []
        for text in texts:
            data = text.encode()
            words = _words(data)
            slots = set(map(_slot, _shape(data)))
            often: dict[int, int] = {}
            for word, n in words.items():
                own, rest = known[word]
                if own >= 0:
                    slots.add(own)
                for k in rest:
                    often[k] = often.get(k, 0) + n
            least = LEAST_RATE * sum(words.values())
            slots.update(k for k, n in often.items() if n >= least)
            out.append(math.fsum(weights[k] for k in slots))  # fsum: the same sum in any order
        return np.array(out)

    return score


def fit(df: DataFrame, labels: DataFrame, grade: Column, top: int, id_col: str = "doc_id", text_col: str = "text", most: int = FIT) -> OrdinalModel:
    """The model of the labelled rows of df; grade: a whole number from 0 to top, an expression of the columns of labels.

    Rows whose grade is null don't count; of several labels of a document the smallest grade holds,
    and of several rows with an id the one with the smallest text.
    """
    graded = labels.select(F.col(id_col).alias("_id"), grade.cast("int").alias("_grade")).where(F.col("_id").isNotNull() & F.col("_grade").between(0, top))
    graded = graded.groupBy("_id").agg(F.min("_grade").alias("_grade"))
    # Only ids that df has, then no more than `most`, in an order without meaning: bounded, so broadcast.
    present = graded.join(df.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id").agg(F.first("_grade").alias("_grade"), F.min("_text").alias("_text"))  # an id may have many rows
    found = map_rows(rows, lambda: lambda c: [c["_id"], c["_grade"], [features(t) for t in c["_text"]]], f"_id {df.schema[id_col].dataType.simpleString()}, _grade int, f array<int>").toArrow()
    # In an order of their own, so that the sums don't depend on Spark's.
    lists = found.column("f").combine_chunks()
    flat, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    own = [flat[s:e] for s, e in zip(bounds, bounds[1:])]
    order = sorted(range(len(own)), key=lambda i: (found.column("_id")[i].as_py(), own[i].tobytes()))
    return fit_arrays([own[i] for i in order], found.column("_grade").to_numpy()[order].astype(np.int64), top)


def rate(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, expected_grade, tail, selected) of each row; tail: the probability of the top grade.

    Null and empty texts are rated by their length alone; equal texts get equal ratings; a null id is
    kept; an empty table gives an empty table; other columns are left out. A model fitted without rows
    has a weight of zero for everything.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES weights, whatever the input

    def make():
        model = shared.value
        score = scorer(model)

        def step(c):
            s = score(c["text"])
            tails = model.tails(s)
            return [c["id"], s.tolist(), tails.sum(axis=1).tolist(), tails[:, -1].tolist(), (tails[:, -1] >= LEAST_TAIL).tolist()]

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_rows(rows, make, f"{id_col} {kind}, score double, expected_grade double, tail double, selected boolean")


def select(df: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of df that rate() selects, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        score = scorer(model)
        return lambda texts: (model.tails(score(texts))[:, -1] >= LEAST_TAIL).tolist()

    return filter_rows(df, text_col, make)
