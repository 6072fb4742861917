"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each whole text: good, bad, or nothing. Spark counts the patterns
of votes over all documents; expectation-maximisation over those counts (as many as patterns, whatever the
corpus) estimates each labeller's accuracy on good texts and on texts with each kind of defect, and so the
probability that a text of a pattern is good. With these posterior labels a bounded, balanced sample trains a hashed linear scorer on
character-class n-grams, which then scores every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.shared import free_memory, whole_row, written

GOOD, BAD, NOTHING = 1, 0, 2
#: (name, at most this is good, from this on bad) of each statistic; between them a labeller says nothing.
LABELLERS = (
    ("symbols", 0.01, 0.03),
    ("trailing_symbols", 0.02, 0.06),
    ("exclamations", 0.01, 0.05),
    ("capitals", 0.25, 0.5),
    ("separators", 0.01, 0.05),
    ("stutter", 0.10, 0.20),
    ("runs", 0.05, 0.12),
    ("not_alphanumeric", 0.20, 0.35),
)
#: Documents of each posterior class that training sees at most.
SAMPLE = 1500
DIMS = 2048
EPOCHS = 300
THRESHOLD = 0.5
_TRAILING = re.compile(r"[\w.,;:]([^\w\s.,;:'\"()\-])\1+(?=\s|$)")
_CLASS_SPECIAL = {c: 6 + i for i, c in enumerate("\n.,;:'\"!?-()[]{}<>|#$%&*+/=@\\^_`~")}
_CLASS = np.array([0 if c.isspace() and c != "\n" else _CLASS_SPECIAL.get(c, 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isalpha() else 5) for c in map(chr, range(1 << 16))], dtype=np.uint32)


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return _CLASS[np.minimum(points, (1 << 16) - 1)]


def statistics(text: str | None) -> tuple[float, ...] | None:
    """The labellers' statistics of a whole text; None without a word."""
    words = (text or "").split()
    if not words:
        return None
    kinds = np.bincount(classes_of(text), minlength=6 + len(_CLASS_SPECIAL))
    at = lambda s: sum(int(kinds[_CLASS_SPECIAL[c]]) for c in s)
    letters, ink = int(kinds[1] + kinds[2] + kinds[4]), int(kinds.sum() - kinds[0] - kinds[_CLASS_SPECIAL["\n"]])
    n = len(words)
    symbols = at("|#$%&*+=@\\^_~<>{}[]")
    trailing = len(_TRAILING.findall(text)) if symbols or at("!?") else 0
    same = np.fromiter(map(hash, words), dtype=np.int64, count=n)
    same = same[1:] == same[:-1]
    cased = int(kinds[1] + kinds[2])
    shares = (symbols / max(ink, 1), trailing / n, at("!") / n, kinds[2] / max(cased, 1) if cased > 20 else 0.0, at("|") / n)
    return (*shares, same.mean() if n >= 20 else 0.0, (same[1:] & same[:-1]).mean() if n >= 20 else 0.0, 1 - (letters + int(kinds[3])) / max(ink, 1))


def votes(found: tuple[float, ...] | None) -> list[int]:
    if found is None:
        return [BAD] * len(LABELLERS)
    return [GOOD if x <= good else BAD if x >= bad else NOTHING for x, (_, good, bad) in zip(found, LABELLERS)]


@dataclass(frozen=True)
class LabelModel:
    """priors[kind] and rates[labeller, vote, kind]: how often a labeller votes so on texts of a kind; kind 0 is good, the others are defects."""

    priors: np.ndarray
    rates: np.ndarray

    def by_kind(self, patterns: np.ndarray) -> np.ndarray:
        log = np.log(self.priors) + np.log(self.rates)[np.arange(patterns.shape[1]), patterns].sum(axis=1)
        odds = np.exp(log - log.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of good for rows of votes."""
        return self.by_kind(patterns)[:, 0]

    def accuracies(self) -> np.ndarray:
        """For each labeller: how often it votes bad on bad texts, and how often on good ones."""
        bad = self.priors[1:] / self.priors[1:].sum()
        return np.stack([self.rates[:, BAD, 1:] @ bad, self.rates[:, BAD, 0]], axis=1)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how often each occurs.

    Each labeller knows one defect, so bad texts aren't alike: beside good there is a hidden kind for each
    labeller, and it starts from the patterns in which that one is the first to vote bad. Labellers that see
    the same defect then share a kind, and their rates show how they overlap. One text's worth of even
    odds in every kind keeps rates above zero; no patterns leave even odds.
    """
    m = patterns.shape[1]
    model = LabelModel(np.full(m + 1, 1 / (m + 1)), np.full((m, 3, m + 1), 1 / 3))
    if not len(patterns):
        return model
    bad = patterns == BAD
    share = np.full((len(patterns), m + 1), 0.1 / m)
    share[np.arange(len(patterns)), np.where(bad.any(axis=1), bad.argmax(axis=1) + 1, 0)] = 0.9
    for _ in range(rounds):
        held = counts[:, None] * share
        rates = np.stack([(patterns == v).T.astype(float) @ held for v in range(3)], axis=1) + 1 / 3
        model = LabelModel((held.sum(axis=0) + 1) / (counts.sum() + m + 1), rates / rates.sum(axis=1, keepdims=True))
        now = model.by_kind(patterns)
        if np.abs(now - share).max() < 1e-9:
            break
        share = now
    return model


def hashed(text: str | None) -> np.ndarray:
    """The scorer's features: shares of hashed character-class 1- to 3-grams, damped, and each labeller's vote."""
    out = np.zeros(DIMS, dtype=np.float32)
    kinds = classes_of(text or "")
    tail = len(LABELLERS) * 3
    room = np.uint32(DIMS - tail)
    if len(kinds):
        one = (kinds + np.uint32(1)) * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (kinds[1:] + np.uint32(1)) * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (kinds[2:] + np.uint32(1)) * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
        grams = sum(np.bincount((h >> np.uint32(8)) % room, minlength=int(room)) for h in (one, two, three))
        out[: int(room)] = np.sqrt(grams / len(kinds))
    for i, v in enumerate(votes(statistics(text))):
        out[int(room) + 3 * i + v] = 1
    return out


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float
    labels: LabelModel


def _trained(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on soft labels: gradient steps with momentum and a light L2."""
    w, b, v, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
    for _ in range(EPOCHS):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - y) * weight
        v, vb = 0.9 * v - 2.0 * (x.T @ error + 1e-5 * w), 0.9 * vb - 2.0 * error.sum()
        w, b = w + v, b + vb
    return w, float(b)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Fits the label model on the vote patterns of all ``docs`` and the scorer on at most SAMPLE texts of either class.

    Samples are the rows with the smallest hash of id and text in a random share of their class, however many
    rows have no id or the same. If all texts fall into one class the scorer keeps its side: everything is then
    good, or bad.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    @F.pandas_udf("string")
    def pattern_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(map(str, votes(statistics(t)))))

    voted = written(rows.select("id", pattern_of("text").alias("pattern")), "votes")
    found = voted.groupBy("pattern").count().toPandas().sort_values("pattern")  # at most 3 to the labellers
    patterns = np.array([list(map(int, p)) for p in found["pattern"]], dtype=int).reshape(-1, len(LABELLERS))
    counts = found["count"].to_numpy(dtype=float)
    model = fit_labels(patterns, counts)
    good = model.posterior(patterns) if len(patterns) else np.zeros(0)
    sides = [counts[good < 0.5].sum(), counts[good >= 0.5].sum()]
    if not min(sides):
        return Scorer(np.zeros(DIMS), 50.0 if sides[1] >= sides[0] else -50.0, model)
    named = [(p, float(g), float(min(1.0, (1.2 * SAMPLE + 50) / sides[int(g >= 0.5)]))) for p, g in zip(found["pattern"], good)]
    known = docs.sparkSession.createDataFrame(named, "pattern string, good double, share double")
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)

    @F.pandas_udf("pattern string, x binary")
    def features(texts: pd.Series) -> pd.DataFrame:
        x = [hashed(t) for t in texts]
        given = [v[-3 * len(LABELLERS) :].reshape(-1, 3).argmax(axis=1) for v in x]
        return pd.DataFrame({"pattern": ["".join(map(str, g)) for g in given], "x": [v.tobytes() for v in x]})

    picked = rows.withColumn("draw", draw).where(F.col("draw") < max(s for _, _, s in named))
    picked = picked.select("id", "draw", features("text").alias("f")).select("id", "draw", "f.pattern", "f.x")
    picked = picked.join(F.broadcast(known), "pattern").where("draw < share")  # one row for each pattern
    first = F.row_number().over(Window.partitionBy(F.col("good") >= 0.5).orderBy("draw", "id", "x"))
    picked = picked.withColumn("first", first).where(F.col("first") <= SAMPLE)  # each task keeps no more than SAMPLE of a class

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "id", "x"])
        w, b = _trained(np.stack([np.frombuffer(x, np.float32) for x in group["x"]]), group["good"].to_numpy())
        return pd.DataFrame({"weights": [w.tobytes()], "bias": [b]})

    got = picked.select("id", "draw", "good", "x").groupBy().applyInPandas(fit, "weights binary, bias double").first()
    return Scorer(np.frombuffer(got["weights"], np.float64), got["bias"], model) if got else Scorer(np.zeros(DIMS), 50.0, model)


def scored(model: Scorer, text: Column) -> Column:
    """A struct (quality_score, weak_label) for each text: the scorer's and the label model's probability of good.

    A null text or one without a word scores 0.
    """

    @F.pandas_udf("quality_score double, weak_label double")
    def score(texts: pd.Series) -> pd.DataFrame:
        scores, weak = [], []
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            x = np.stack([hashed(t) for t in part]).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -50, 50)))
            given = x[:, -3 * len(LABELLERS) :].reshape(len(x), len(LABELLERS), 3).argmax(axis=2)
            empty = np.array([not (t or "").split() for t in part])
            scores += np.where(empty, 0.0, p).tolist()
            weak += model.labels.posterior(given).tolist()
        free_memory()
        return pd.DataFrame({"quality_score": scores, "weak_label": weak})

    return score(text.cast("string"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, quality_score, weak_label, keep), one per row of ``docs``; keep is quality_score >= THRESHOLD.

    A null text or one without a word scores 0 and isn't kept. Repeated rows score alike, null ids score by
    their text, long texts count whole, other columns are ignored, and no rows give none.
    """
    model = train(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), scored(model, F.col(text_col)).alias("q"))
    return rows.select("doc_id", "q.quality_score", "q.weak_label", (F.col("q.quality_score") >= THRESHOLD).alias("keep"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without the rows that the classifier, trained on their own weak labels, rejects; whole.

    Columns of any name stay as they are; other cases as in ``classify``.
    """
    known = docs.select(whole_row(docs), scored(train(docs), docs["text"]).alias("q"))
    return known.where(F.col("q.quality_score") >= THRESHOLD).select("row.*")
