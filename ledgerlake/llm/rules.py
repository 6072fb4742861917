"""Quality rules as weak supervision.

Each rule looks at one statistic of a whole text and votes good or bad, or abstains between its two bounds and
where a text is too short to tell. Spark counts the patterns of votes over all documents; from these counts,
at most 3 to the number of rules whatever the corpus, expectation-maximisation estimates how often each rule
votes which way on good and on bad texts. The posterior probability of good then decides, so one odd
statistic doesn't reject a text as a filter that asks it to pass every rule would.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.quality import classes_of
from ledgerlake.llm.shared import freed, whole_row, written

BAD, GOOD, ABSTAINS = 0, 1, 2
#: Rule: (its statistic is good up to here, bad from here on); between them it abstains.
RULES = {
    "symbols_a_word": (0.1, 0.3),
    "signs_in_ink": (0.12, 0.25),
    "words_ending_in_sign_runs": (0.02, 0.1),
    "lone_signs": (0.03, 0.15),
    "capitals": (0.3, 0.6),
    "shouted_words": (0.1, 0.5),
    "exclamations_a_word": (0.02, 0.1),
    "stutter": (0.02, 0.1),
    "repeated_words": (0.2, 0.5),
    "duplicate_lines": (0.1, 0.3),
    "odd_word_length": (np.log(2), np.log(3.5)),
}
#: Texts of fewer words get no votes.
LEAST_WORDS = 20
#: Base rules: fewer words, or a larger percentage of words in repeated windows, fail a text.
BASE_WORDS, BASE_REPEATED = 50, 50
WINDOW = 3
THRESHOLD = 0.5
#: The counted symbols.
SYMBOLS = b"#*$%&|<>"
_SIGN_RUN = re.compile(r"[^\w\s]*([^\w\s.\-'\")\]])\1+(?=\s|\Z)")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words, given by number, that stand in a window whose words occur in that order at another place too."""
    if len(numbers) <= window:
        return 0
    keys = numbers
    for i in range(1, window):  # windows by number: pairs of a shorter window's number and the next word's
        ends = numbers[i:]
        keys = np.unique(keys[: len(ends)] * (int(numbers.max()) + 1) + ends, return_inverse=True)[1]
    twice = np.bincount(keys)[keys] > 1
    covered = np.zeros(len(numbers), dtype=bool)
    for i in range(window):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def measured(text: str | None) -> tuple[tuple[int, ...], str]:
    """(the five counts, the votes as digits) of a whole text; words stand between ASCII white space."""
    raw = (text or "").encode()
    words = raw.split()  # of bytes: ASCII white space only
    n = len(words)
    if not n:
        return (0, 0, sum(raw.count(s) for s in SYMBOLS), 0, 0), str(ABSTAINS) * len(RULES)
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    chars = len(text) - sum(map(raw.count, b" \t\n\v\f\r"))
    symbols, repeated = sum(raw.count(s) for s in SYMBOLS), repeated_words(numbers)
    counts = (n, chars, symbols, len(lines) - len(set(lines)), repeated)
    if n < LEAST_WORDS:
        return counts, str(ABSTAINS) * len(RULES)
    kinds = np.bincount(classes_of(text), minlength=6)
    lower, upper, uncased = int(kinds[1]), int(kinds[2]), int(kinds[4])
    letters = lower + upper + uncased
    each = text.split()
    mean = chars / n
    found = (
        symbols / n,
        1 - (letters + int(kinds[3])) / max(chars, 1),
        sum(1 for _ in _SIGN_RUN.finditer(text)) / n,
        sum(not any(map(str.isalnum, w)) for w in each if len(w) < 4) / n,
        upper / (lower + upper) if lower + upper >= LEAST_WORDS else None,
        sum(w.isupper() and len(w) > 1 for w in each) / n if lower + upper >= LEAST_WORDS else None,
        raw.count(b"!") / n,
        float((numbers[1:] == numbers[:-1]).mean()),
        repeated / n,
        counts[3] / len(lines) if len(lines) > 3 else None,
        abs(np.log(mean / 5)) if uncased < 0.3 * letters or not letters else None,  # scripts without cased letters may not part words
    )
    votes = (ABSTAINS if x is None else GOOD if x <= good else BAD if x >= bad else ABSTAINS for x, (good, bad) in zip(found, RULES.values()))
    return counts, "".join(map(str, votes))


@dataclass(frozen=True)
class RuleModel:
    """prior of good, and rates[rule, vote, class]: how often a rule votes so on texts of class BAD and GOOD."""

    prior: float
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of good for rows of votes."""
        log = np.log(self.rates)[np.arange(votes.shape[1]), votes].sum(axis=1) + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(log[:, BAD] - log[:, GOOD], -700, 700)))

    def accuracies(self) -> np.ndarray:
        """How often each rule is right when it votes."""
        right = self.rates[:, BAD, BAD] * (1 - self.prior) + self.rates[:, GOOD, GOOD] * self.prior
        wrong = self.rates[:, GOOD, BAD] * (1 - self.prior) + self.rates[:, BAD, GOOD] * self.prior
        return right / (right + wrong)


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> RuleModel:
    """Expectation-maximisation over distinct patterns of votes and how many texts have each.

    It starts from votes weighed by how rare they are: a bad vote that few texts get says more than a good one
    that nearly all get. A rule is never believed to be worse than chance: where its bad votes turn out as
    common on good texts as on bad ones, both get its overall rates. Half a text of even votes keeps rates
    above zero. No patterns leave even odds.
    """
    m = votes.shape[1]
    if not len(votes):
        return RuleModel(0.5, np.full((m, 3, 2), 1 / 3))
    shown = np.stack([votes == v for v in range(3)], axis=2)  # pattern, rule, vote
    overall = (np.einsum("p,prv->rv", counts, shown) + 0.5) / (counts.sum() + 1.5)
    weighed = (shown[:, :, BAD] * np.log(overall[:, BAD]) - shown[:, :, GOOD] * np.log(overall[:, GOOD])).sum(axis=1)
    share = np.where(weighed >= 0, 0.9, 0.1)
    for _ in range(rounds):
        held = counts[:, None] * np.stack([1 - share, share], axis=1)
        rates = np.einsum("pc,prv->rvc", held, shown) + 0.5
        rates /= rates.sum(axis=1, keepdims=True)
        idle = rates[:, BAD, BAD] <= rates[:, BAD, GOOD]
        rates[idle] = overall[idle][:, :, None]
        model = RuleModel(float((held[:, GOOD].sum() + 1) / (counts.sum() + 2)), rates)
        now = model.posterior(votes)
        if np.abs(now - share).max() < 1e-10:
            break
        share = now
    return model


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` (row, text) with the counts and votes of each text instead of the text."""
    row = docs.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [measured(t) for t in batch.column(1).to_pylist()]
            counts = zip(*(c for c, _ in found)) if found else [()] * len(_COUNTS)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([v for _, v in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", *_COUNTS, "votes"])

    return docs.select("row", F.col(text_col).cast("string").alias("text")).mapInArrow(freed(run), f"row {row}, {', '.join(f'{c} long' for c in _COUNTS)}, votes string")


def _judged(counted: DataFrame) -> DataFrame:
    """Rows of ``_counted``, written already, with quality_probability, base_failed and kept."""
    patterns = counted.where("n_words > 0").groupBy("votes").count().toPandas().sort_values("votes")  # at most 3 to the rules
    votes = np.array([list(map(int, v)) for v in patterns["votes"]], dtype=int).reshape(-1, len(RULES))
    model = fit(votes, patterns["count"].to_numpy(dtype=float))
    known = [(v, float(p)) for v, p in zip(patterns["votes"], model.posterior(votes))]
    odds = counted.sparkSession.createDataFrame(known, "votes string, quality_probability double")
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words"))
    rows = counted.join(F.broadcast(odds), "votes", "left")  # one row for each pattern
    rows = rows.withColumn("quality_probability", F.when(F.col("n_words") > 0, F.col("quality_probability")).otherwise(0.0))
    return rows.withColumns({"base_failed": failed, "kept": ~failed & (F.col("quality_probability") >= THRESHOLD)})


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality_probability, votes), one per row of ``docs``.

    votes has a digit a rule, in the order of RULES: 0 bad, 1 good, 2 none. A null text has no words; a text
    without a word has probability 0, fails the base rules and isn't kept. Texts of fewer than LEAST_WORDS words
    get no votes, so the prior decides. A probability on the threshold is kept. Repeated rows are judged alike,
    null ids stay null, long texts count whole, other columns are ignored, and no rows give none.
    """
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("row"), F.col(text_col).alias("text"))
    found = _judged(written(_counted(rows, "text"), "rule-votes"))
    return found.select("row.doc_id", *_COUNTS, "base_failed", "kept", "quality_probability", "votes")


def keep_passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, whole; columns of any name stay as they are."""
    found = _judged(written(_counted(docs.select(whole_row(docs), docs[text_col].alias("text")), "text"), "rule-votes"))
    return found.where("kept").select("row.*")
