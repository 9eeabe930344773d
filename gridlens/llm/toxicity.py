"""Toxic passages by maximum-scoring segments.

Log-odds with an informative Dirichlet prior, drawn towards zero by ``DOUBT`` standard errors,
score every word and every stem (first ``STEM`` letters) that a bounded labelled sample holds
often enough, for or against; a word that leaves it open goes by its stem, as far as its own
doubt allows, since languages with many endings spread a word's evidence. Each word costs
``COST`` besides, which makes the mean score of clean text negative. The extreme-value
rate is solved from the scores' distribution in clean text, and scores are scaled by it. A
linear scan finds all maximal segments of a text. A segment of score S in n words is expected
K n exp(-S) times by chance; K is estimated on clean documents. The logs by which the segments
beat chance add up to the evidence, whose log a logistic fit turns into a probability. K and the
fit use scores from words that were learnt on other folds of the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents of either class that the model is fitted on, least hash of the id first. The fit weighs them so that classes count as they occur.
SAMPLE, FOLDS = 10_000, 4
#: Weight of the prior (documents), standard errors taken off log-odds, documents that must hold a word, cost of a word, score from which K is counted.
PRIOR, DOUBT, LEAST_DOCS, COST, COUNTED = 50.0, 2.5, 5, 0.1, 2.0
STEM = 5
#: Words whose gain a worker remembers.
REMEMBERED = 500_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of runs (start, end, score), in linear time.

    Each open segment keeps the running sums before it and at its end; a new one that
    reaches higher than an earlier one that starts lower swallows all from there on. It also
    keeps which earlier one that was, for all between start higher still: a later search that
    passes it passes those at once.
    """
    total = 0.0
    open_: list[tuple[float, float, int, int, int]] = []
    for start, end, gain in scores:
        low, total = total, total + gain
        if gain <= 0:
            continue
        k = len(open_) - 1
        while True:
            while k >= 0 and open_[k][0] >= low:
                k = open_[k][4]
            if k < 0 or open_[k][1] >= total:
                break
            low, _, start, _, before = open_[k]
            del open_[k:]
            k = before
        open_.append((low, total, start, end, k))
    return [(s, e, high - low) for low, high, s, e, _ in open_]


def stem_of(word: str) -> str:
    return word[:STEM] + "*"


class Gains(dict):
    """Gain of any word, from those of words and stems; None where it has none."""

    def __init__(self, told: dict[str, float]):
        super().__init__(told)
        self.told = told

    def __missing__(self, word: str) -> float | None:
        if len(self) > REMEMBERED:
            self.clear()
            self.update(self.told)
        self[word] = out = self.told.get(stem_of(word)) if len(word) >= STEM else None
        return out


def passages(words: list[str], gains: Gains, cost: float) -> list[tuple[int, int, float]]:
    """Maximal segments over the words of a text; words without a gain cost ``cost``, and runs of them count as one."""
    runs, at, some = [], 0, False
    for i, gain in enumerate(map(gains.__getitem__, words)):
        if gain is not None:
            if i > at:
                runs.append((at, i, (at - i) * cost))
            runs.append((i, i + 1, gain))
            at, some = i + 1, some or gain > 0
    return maximal_segments(runs) if some else []


def evidence(segments: list[tuple[int, int, float]], n: int, rate: float) -> float:
    """The logs by which segments beat chance, added up, on a log scale (their order decides, and a few are extreme)."""
    return math.log1p(sum(max(0.0, s - math.log(rate * max(1, n))) for _, _, s in segments))


def _sample(labels: DataFrame, id_col: str, learn) -> tuple[DataFrame, dict[int, float]]:
    """(_id, toxic) of at most ``SAMPLE`` documents of either class that ``learn`` allows; how many labelled ones each stands for."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    own = common.cut(own.where(learn("_id")).groupBy("_id").agg(F.max("toxic").alias("toxic")))
    some = lambda c: own.where(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    return some(1).union(some(0)), {t: max(1.0, n / SAMPLE) for t, n in own.groupBy("toxic").agg(F.count(F.lit(1))).collect()}


def _described(batches):
    """The distinct words and stems of each text with their counts, and a mark that near copies often share."""
    for batch in common.text_batches(batches, 2 << 20):
        marks, sets, counts = [], [], []
        for data in common.binary_values(batch.column(2)):
            words = words_of(data.decode("utf-8", "replace"))
            h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
            # Three least hashes: texts that share no more than a passage seldom agree on all.
            marks.append(xxhash.xxh64_intdigest(b"".join((h * k).min().tobytes() for k in _ODD)))
            many = Counter(words)
            for w, n in list(many.items()):
                if len(w) >= STEM:
                    many[stem_of(w)] += n
            sets.append(list(many))
            counts.append(list(many.values()))
        columns = [pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["_id", "toxic", "mark", "words", "counts"])


_ODD = [np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def rate_of(scores: np.ndarray, shares: np.ndarray) -> float:
    """The extreme-value rate: the positive root of sum(shares * exp(rate * scores)) = 1; 1 where there is none."""
    if not (scores > 0).any() or (scores * shares).sum() >= 0:
        return 1.0
    excess = lambda x: (shares * np.exp(np.minimum(x * scores, 700.0))).sum() - 1
    high = 1.0
    while excess(high) < 0 and high < 1e6:
        high *= 2
    low = 0.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def leanings(toxic: np.ndarray, clean: np.ndarray, docs: list[int], pairs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of words and ``DOUBT`` standard errors of them.

    ``toxic`` and ``clean``: documents of either class that hold a word; ``docs``: how many there
    are; ``pairs``: of documents and their distinct words.
    """
    y = np.maximum(toxic + clean, 1e-3)
    prior, whole = PRIOR * y / sum(docs), PRIOR * sum(pairs) / sum(docs)
    y1, y0 = toxic + prior, clean + prior
    odds = np.log(y1 / (pairs[0] + whole - y1)) - np.log(y0 / (pairs[1] + whole - y0))
    return odds, np.where(toxic + clean < LEAST_DOCS, np.inf, DOUBT * np.sqrt(1 / y1 + 1 / y0))


def _drawn(odds: np.ndarray, doubt: np.ndarray) -> np.ndarray:
    return np.sign(odds) * np.maximum(0, np.abs(odds) - doubt)


def word_scores(names: list[str], odds: np.ndarray, doubt: np.ndarray, tokens: np.ndarray, all_tokens: int) -> tuple[dict[str, float], float]:
    """(gains of words and stems, cost of any other word) at an extreme-value rate of one; ``tokens``: their counts in clean text."""
    own = _drawn(odds, doubt)
    at = {w: k for k, w in enumerate(names)}
    stem = np.array([at.get(stem_of(w), -1) if w[-1] != "*" and len(w) >= STEM else -1 for w in names], np.int64)
    told = np.where(stem >= 0, own[stem], 0.0) if len(names) else own
    unsure = (own == 0) & (stem >= 0)
    own = np.where(unsure, np.clip(told, odds - doubt, odds + doubt), own)
    # A stem stands for its words that have no entry of their own.
    left = tokens + 0.5  # a word never seen in clean text may still occur there
    np.subtract.at(left, stem[stem >= 0], tokens[stem >= 0])
    is_stem = np.array([w[-1] == "*" for w in names], bool)
    shares = np.append(left, all_tokens - tokens[~is_stem].sum() - left[is_stem].sum()) / max(1, all_tokens)
    rate = rate_of(np.append(own, 0.0) - COST, np.maximum(shares, 0))
    needed = np.where(is_stem | (stem < 0), own != 0, own != told)
    return {names[k]: float((own[k] - COST) * rate) for k in np.flatnonzero(needed)}, COST * rate


def _learnt(told: DataFrame) -> list[tuple[dict[str, float], float]]:
    """(gains, cost) from all folds but one, for each fold, then from all."""
    folds = range(FOLDS)
    mine = lambda f, c: F.sum(F.when(F.col("fold") == f, c).otherwise(0))
    sums = [mine(f, c).alias(f"{n}{f}") for f in folds for n, c in (("a", F.col("toxic")), ("b", 1 - F.col("toxic")), ("t", (1 - F.col("toxic")) * F.col("x.counts")))]
    each = told.select("fold", "toxic", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    # Words of a bounded sample that LEAST_DOCS of its documents or more hold.
    table = each.groupBy(F.col("x.words").alias("w")).agg(*sums, F.count(F.lit(1)).alias("y")).where(F.col("y") >= LEAST_DOCS).drop("y").toArrow()
    every = each.groupBy(F.col("x.words").endswith("*").alias("w")).agg(*sums).toArrow()
    docs = {(r[0], r[1]): r[2] for r in told.groupBy("fold", "toxic").agg(F.count(F.lit(1))).collect()}
    names, out = table["w"].to_pylist(), []
    is_stem, stems = np.array([w[-1] == "*" for w in names], bool), np.array(every["w"].to_pylist(), bool)
    for left_out in (*folds, None):
        kept = [f for f in folds if f != left_out]
        total = lambda rows, n: sum((rows[f"{n}{f}"].to_numpy().astype(np.int64) for f in kept), np.zeros(len(rows), np.int64))  # noqa: E731, B023
        n = [sum(docs.get((f, t), 0) for f in kept) for t in (1, 0)]
        if not all(n) or not names:
            out.append(({}, COST))
            continue
        odds, doubt = np.zeros(len(names)), np.zeros(len(names))
        for kind in (False, True):
            pairs = [int(total(every, c)[stems == kind].sum()) + 1 for c in "ab"]
            some = is_stem == kind
            odds[some], doubt[some] = leanings(total(table, "a")[some], total(table, "b")[some], n, pairs)
        out.append(word_scores(names, odds, doubt, total(table, "t"), int(total(every, "t")[~stems].sum())))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge."""
    weight = weight / max(1e-9, weight.sum())
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([np.sum(weight * (p - y)) + 1e-6 * a, np.sum(weight * (p - y) * x) + 1e-6 * b])
        w = weight * p * (1 - p)
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max() / 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), max(0.0, float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn=lambda c: F.lit(True)) -> dict:
    """Word scores, cost, chance rate and logistic coefficients; without both classes everything scores 0.

    A document labelled twice counts as toxic if one label says so. Rows that repeat an id are
    examples each, but of near copies with one label one counts for the words. Null labels,
    texts and ids teach nothing. Long texts count whole. Other columns are ignored.
    """
    sample, standing = _sample(labels, id_col, learn)
    sample = common.cut(sample)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).join(F.broadcast(sample), "_id").select("_id", "toxic", "_t")  # 2 x SAMPLE ids at most
    kind = docs.schema[id_col].dataType.simpleString()
    told = own.mapInArrow(_described, f"_id {kind}, toxic int, mark long, words array<string>, counts array<long>")
    fold = F.expr(f"CAST(pmod(xxhash64(mark), {FOLDS}) AS INT)").alias("fold")
    told = common.cut(told.select("_id", "toxic", "mark", fold, "words", "counts"))
    # Of near copies one counts, else the words of one often copied document seem significant.
    models = _learnt(common.cut(told.groupBy("mark", "toxic").agg(F.min("fold").alias("fold"), F.min_by(F.struct("words", "counts"), "_id").alias("x")).select("toxic", "fold", "x.*")))
    none = {"gains": {}, "cost": COST, "rate": 1.0, "a": -30.0, "b": 0.0}
    if not models[-1][0]:
        return none

    def segments(batches):
        gains = [(Gains(g), cost) for g, cost in models]
        for batch in common.text_batches(batches, 2 << 20):
            n, found = [], []
            for data, fold in zip(common.binary_values(batch.column(2)), batch.column(3).to_pylist()):
                words = words_of(data.decode("utf-8", "replace"))
                n.append(len(words))
                found.append([s for _, _, s in passages(words, *gains[fold])])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    folded = own.join(F.broadcast(told.groupBy("_id").agg(F.min("fold").alias("fold"))), "_id").select("_id", "toxic", "_t", "fold")  # 2 x SAMPLE ids at most
    rows = folded.mapInArrow(segments, "toxic int, n long, scores array<double>").collect()  # 2 x SAMPLE rows, or a little more if ids repeat
    chance = sum(s >= COUNTED for t, _, found in rows if not t for s in found) + 1
    rate = chance * math.exp(COUNTED) / max(1, sum(n for t, n, _ in rows if not t))
    x = np.array([evidence([(0, 0, s) for s in found], n, rate) for _, n, found in rows])
    a, b = _logistic(x, np.array([t for t, _, _ in rows], float), np.array([standing.get(t, 1.0) for t, _, _ in rows]))
    return {"gains": models[-1][0], "cost": models[-1][1], "rate": rate, "a": a, "b": b}


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, score (0 to 1), passages (start and end word, score) that beat chance.

    Null and empty texts have no passage and score like any text without. Repeated rows and
    ids are scored each for itself, long texts whole. Other columns are ignored.
    """

    def run(batches):
        gains = Gains(model["gains"])
        for batch in common.text_batches(batches, 2 << 20):
            out, found = [], []
            for data in common.binary_values(batch.column(1)):
                words = words_of(data.decode("utf-8", "replace"))
                segments = passages(words, gains, model["cost"])
                x = model["a"] + model["b"] * evidence(segments, len(words), model["rate"])
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                found.append([{"s": s, "e": e, "score": g} for s, e, g in segments if g > math.log(model["rate"] * max(1, len(words)))])
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(found, kind)], [id_col, "score", "passages"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(id_col, F.col(text_col).cast("string").alias("_t"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, score double, passages array<struct<s: int, e: int, score: double>>")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0
    model = fit(docs, labels, learn=lambda c: ~held(c))
    out = scored(docs, model)
    return out.select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
