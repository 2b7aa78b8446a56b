"""Quality rules: fixed rules on counts, then an isolation forest on rule statistics.

The counts of every text are worked out where the text is read. The forest is grown from a bounded
sample of the labelled rows rated good (FIT rows, chosen by hash; each tree splits SUBSAMPLE of them
at random, within the ranges that all labelled rows span), so what is isolated by few splits is unlike
good text. The threshold on the score is the one that separates the labelled rows best; it is found
over all labelled rows, by their counts in narrow bands of the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import cut, filter_rows, map_rows, text_of

#: Labelled good rows that the forest is grown from at most; trees; rows of a tree; bands of the score.
FIT, TREES, SUBSAMPLE, BANDS = 4096, 100, 256, 1000
#: Share of the good labelled rows that the threshold may reject.
MOST_GOOD_LOST = 0.002
SEED = 17

SYMBOLS = re.compile("[#*$%&|<>]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest looks at, from the counts of one text.
STATISTICS = ("mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "punct_share")


def counts(text: str) -> tuple[list[int], list[float]]:
    """BASE and STATISTICS of one text."""
    data = text.encode()
    found = data.split()  # bytes: split at the six ASCII spaces only
    n = len(found)
    if not n:
        return [0, 0, len(SYMBOLS.findall(text)), 0, 0], [0.0] * len(STATISTICS)
    ascii_space = len(data) - sum(map(len, found))
    word_chars = len(text) - ascii_space
    symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = Counter(line for line in data.split(b"\n") if line.split())
    dup = sum(lines.values()) - len(lines)
    repeated = 0
    if n >= 3:
        windows = list(zip(found, found[1:], found[2:]))
        often = Counter(windows)
        if len(often) < len(windows):
            inside = np.fromiter((often[w] > 1 for w in windows), bool, len(windows))
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(windows)] |= inside
            repeated = int(covered.sum())
    upper = sum(1 for w in found if w.isupper())
    punct = len(data) - len(data.translate(None, b".,;:!?"))
    rate = lambda k: math.log1p(100 * k / n)  # noqa: E731  by orders of size: one in a hundred words counts as much as one more in each word
    stats = [math.log(word_chars / n), rate(symbols), dup / sum(lines.values()), repeated / n, rate(upper), math.log1p(punct / n)]
    return [n, word_chars, symbols, dup, repeated], stats


def base_failed(base: list[int]) -> bool:
    n, *_, repeated = base
    return n < 50 or 100 * repeated > 50 * n


class IsolationForest:
    """Trees of random splits as arrays: feature (-1 in a leaf), threshold, left child, path length of a leaf.

    A split is drawn from the node's whole box, not from the span of its rows. So a statistic that is the
    same in all good rows is split too, and rows that differ in it end in leaves without good rows.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.subsample = min(subsample, len(rows))
        depth = max(1, math.ceil(math.log2(max(2, self.subsample))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.subsample, replace=False)], low, high, depth, rng) for _ in range(trees if len(rows) else 0)]

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of a search among n rows that ends outside them."""
        return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[tuple[int, float, int, float]] = []
        todo = [(rows, low, high, 0)]
        for own, lowest, highest, at in todo:  # grows while it is read: breadth first
            open_ = np.flatnonzero(highest > lowest)
            if at >= depth or len(own) < 2 or not len(open_):
                nodes.append((-1, 0.0, 0, at + self.expected(len(own))))
                continue
            f = int(rng.choice(open_))
            t = float(rng.uniform(lowest[f], highest[f]))
            nodes.append((f, t, len(todo), 0.0))
            left_high, right_low = highest.copy(), lowest.copy()
            left_high[f] = right_low[f] = t
            todo += [(own[own[:, f] <= t], lowest, left_high, at + 1), (own[own[:, f] > t], right_low, highest, at + 1)]
        return tuple(np.array(x) for x in zip(*nodes))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over its expectation: near 1 for what is isolated at once."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        if not self.trees:
            return total
        for feature, threshold, child, length in self.trees:
            at = np.zeros(len(rows), int)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, child[at] + (rows[every, f] > threshold[at]), at)
            total += length[at]
        return np.exp2(-total / len(self.trees) / max(self.expected(self.subsample), 1e-9))


def threshold_of(bands: list[tuple[int, bool, int]]) -> float:
    """From the numbers of (band, good, rows): the score from which on rows are rejected.

    It rejects the most bad rows less good ones, by their shares, of those that reject no more than
    MOST_GOOD_LOST of the good rows; of equal ones the middle. Without good or bad rows nothing is rejected.
    """
    good, bad = np.zeros(BANDS + 2), np.zeros(BANDS + 2)
    for band, is_good, n in bands:
        (good if is_good else bad)[min(max(band, 0), BANDS)] += n
    if not good.sum() or not bad.sum():
        return float("inf")
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= MOST_GOOD_LOST, caught - lost, -1.0)
    if gain.max() <= 0:
        return float("inf")
    best = np.flatnonzero(gain == gain.max())
    return float(best[(len(best) - 1) // 2]) / BANDS


def _measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def step(c):
        found = [counts(t) for t in c["text"]]
        return [c["id"], *map(list, zip(*[b for b, _ in found])), [base_failed(b) for b, _ in found], [s for _, s in found]] if found else [[] for _ in range(len(BASE) + 3)]

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_rows(rows, lambda: step, f"{id_col} {kind}, {', '.join(f'{b} bigint' for b in BASE)}, base_failed boolean, stats array<double>")


def _scored(df: DataFrame, forest: IsolationForest) -> DataFrame:
    """df with the score of its stats instead of them."""
    names = [c for c in df.columns if c != "stats"]
    shared = df.sparkSession.sparkContext.broadcast(forest)  # TREES trees of SUBSAMPLE rows, whatever the input

    def make():
        forest = shared.value
        return lambda c: [*(c[n] for n in names), forest.score(np.array(c["stats"], float).reshape(-1, len(STATISTICS))).tolist()]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "stats")
    return map_rows(df, make, f"{schema}, score double")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[IsolationForest, float]:
    """The forest and its threshold, from the labelled rows of df; a label of at least 1 is good.

    Of several labels of a document the largest holds; null labels and labels of other documents don't count.
    """
    return _fit(_measured(df, id_col, text_col), labels, id_col, label_col)


def _fit(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str = "quality") -> tuple[IsolationForest, float]:
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) >= 1).alias("good"))
    labelled = cut(measured.select(id_col, "base_failed", "stats").join(known, id_col).where("not base_failed").select(id_col, "good", "stats"))
    sides = labelled.agg(*[f(F.col("stats")[i]) for f in (F.min, F.max) for i in range(len(STATISTICS))]).first()
    low, high = (np.array([x or 0.0 for x in part]) for part in (sides[: len(STATISTICS)], sides[len(STATISTICS) :]))
    for i in (STATISTICS.index("dup_line_share"), STATISTICS.index("repeat_share")):
        low[i], high[i] = 0.0, 1.0  # shares are split over all that they can be
    sample = labelled.where("good").orderBy(F.xxhash64(id_col), id_col).limit(FIT).select("stats").collect()
    forest = IsolationForest(np.array([r[0] for r in sample]).reshape(-1, len(STATISTICS)), low, high)
    bands = _scored(labelled, forest).groupBy(F.floor(F.col("score") * BANDS).cast("int"), "good").count().collect()  # at most 2 * BANDS rows
    return forest, threshold_of([tuple(r) for r in bands])


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of each row.

    Null and empty texts have no words and fail the base rules; repeated rows are judged each; a null id
    is kept; without usable labels the base rules decide alone; an empty table gives an empty table;
    other columns are left out. Every text is measured once, and the numbers are kept for fit and verdict.
    """
    measured = cut(_measured(df, id_col, text_col))
    forest, threshold = _fit(measured, labels, id_col)
    rows = _scored(measured, forest)
    return rows.select(id_col, *BASE, "base_failed", (~F.col("base_failed") & (F.col("score") < threshold)).alias("kept"), "score")


def keep(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that judge() keeps, with all their columns.

    Texts are measured twice, for the fit and where they are filtered: to join the numbers of the first
    time to the rows would shuffle all texts.
    """
    forest, threshold = fit(df, labels, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def make():
        forest = shared.value

        def verdicts(texts: list[str]) -> list[bool]:
            found = [counts(t) for t in texts]
            scores = forest.score(np.array([s for _, s in found], float).reshape(-1, len(STATISTICS)))
            return [not base_failed(b) and bool(s < threshold) for (b, _), s in zip(found, scores)]

        return verdicts

    return filter_rows(df, text_col, make)
