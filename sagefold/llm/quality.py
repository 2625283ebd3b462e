"""Quality rules as weak supervision.

Each rule votes for good (1), for bad (-1) or abstains (0).  The counts of all
vote patterns over the whole table (three to the power of the number of rules at
most, whatever the input) go to the driver, where expectation-maximisation
estimates how often each rule votes which way on good and on bad documents.  A
document's posterior probability of being good then takes the place of passing
every rule.

Null and empty texts have no words: counts are 0, every rule abstains but the
one on length.  Repeated rows each have their counts and count each in the
patterns.  Very long texts are counted whole, by one task each.  Of the input's
columns only the id and the text are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, map_columns, materialise, texts

SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters", "n_upper", "n_ended_lines", "n_marks"]


def count(text: str, codes: dict[bytes, int]) -> list[int]:
    """The numbers named in COUNTS.  ``codes`` numbers words; it may be emptied between calls."""
    data = text.encode()
    words = data.split()  # for bytes these are the six blanks only
    n = len(words)
    repeated = distinct = 0
    if n:
        for w in words:
            if w not in codes:
                codes[w] = len(codes)
        ids = np.array([codes[w] for w in words], np.int64)
        distinct = len(set(words))
        if n > 3:
            _, ids = np.unique(ids, return_inverse=True)
            width = int(ids.max()) + 1
            pairs = ids[:-1] * width + ids[1:]
            _, pairs = np.unique(pairs, return_inverse=True)
            windows = pairs[:-1].astype(np.int64) * width + ids[2:]
            _, at, many = np.unique(windows, return_inverse=True, return_counts=True)
            hit = many[at] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= hit
            repeated = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return [
        n,
        len(text) - sum(text.count(b) for b in BLANKS),
        len(_SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        distinct,
        len(_LETTER.findall(text)),
        len(_UPPER.findall(text)),
        sum(x.rstrip(BLANKS)[-1] in ".!?:;\"'。" for x in lines),
        text.count("!") + text.count("..."),
    ]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS...) of every row."""

    def make():
        codes: dict[bytes, int] = {}

        def step(column: pa.Array) -> list:
            if len(codes) > 500_000:
                codes.clear()
            rows = []
            for x in texts(column):
                rows.append(count(x, codes))
            return list(zip(*rows, strict=True)) or [[] for _ in COUNTS]

        return step

    return map_columns(docs, [id_col], [text_col], T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]), make)


def _vote(bad: Column, good: Column | None = None) -> Column:
    """-1 where ``bad`` holds, 1 where ``good`` holds, else 0."""
    fine = F.lit(False) if good is None else F.coalesce(good, F.lit(False))
    return F.when(F.coalesce(bad, F.lit(False)), -1).when(fine, 1).otherwise(0)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.when(F.col(b) > 0, F.col(b))


def rules() -> dict[str, Column]:
    """The voters over COUNTS.  Without words all but ``length`` abstain.

    Most rules know one fault and abstain where they do not see it: a document
    that has one fault passes all other rules, so that not seeing a fault says
    little.  ``length`` and ``prose`` vote for good documents.
    """
    n = F.col("n_words")
    mean = _share("word_chars", "n_words")
    symbols = _share("n_symbols", "n_words")
    lines = _share("n_dup_lines", "n_lines")
    repeats = _share("n_repeat_words", "n_words")
    upper = _share("n_upper", "n_letters")
    letters = _share("n_letters", "word_chars")
    ended = _share("n_ended_lines", "n_lines")
    marks = _share("n_marks", "n_words")
    return {
        "length": _vote(n < 20, n >= 100),
        "word_length": _vote((mean < 2.5) | (mean > 14)),
        "symbols": _vote(symbols > 0.3),
        "lines": _vote(lines > 0.3),
        "repeats": _vote(repeats > 0.35),
        "capitals": _vote(upper > 0.4),
        "letters": _vote(letters < 0.75),
        # a text has about its length to some power of distinct words
        "variety": _vote((F.col("n_distinct") > 0) & (F.log(F.col("n_distinct").cast("double")) < 0.6 * F.log(n.cast("double")))),
        "endings": _vote((ended < 0.1) & (F.col("n_lines") > 5)),
        "marks": _vote(marks > 0.3),
        "prose": _vote(F.lit(False), (symbols < 0.03) & (letters > 0.85) & (upper < 0.2) & (ended > 0.5) & (marks < 0.05)),
    }


@dataclass
class LabelModel:
    """Rates of the votes -1, 0, 1 of each rule on bad and on good documents."""

    prior: float
    rates: np.ndarray  # 2 x rules x 3
    rounds: int

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(votes.shape[1])
        log = np.stack([np.log(self.rates[y][at, votes + 1]).sum(1) for y in (0, 1)])
        odds = np.log(self.prior / (1 - self.prior)) + log[1] - log[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """How often each rule is right where it votes."""
        y = np.array([1 - self.prior, self.prior])
        right = y[0] * self.rates[0][:, 0] + y[1] * self.rates[1][:, 2]
        wrong = y[0] * self.rates[0][:, 2] + y[1] * self.rates[1][:, 0]
        return right / (right + wrong)


def fit(votes: np.ndarray, weights: np.ndarray, rounds: int = 200, tolerance: float = 1e-7) -> LabelModel:
    """Expectation-maximisation over the distinct vote patterns and their counts.

    It starts from whether any rule votes for bad, so that "good" keeps its
    meaning; smoothing by one document keeps each rate above 0.
    """
    m = votes.shape[1]
    weights = weights.astype(float)
    q = np.where((votes == -1).any(1), 0.1, 0.9)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    model = LabelModel(0.5, np.full((2, m, 3), 1 / 3), 0)
    for k in range(rounds):
        rates = []
        for y in (1 - q, q):
            n = np.einsum("i,ijk->jk", weights * y, one_hot) + 1.0
            rates.append(n / n.sum(1, keepdims=True))
        prior = float(np.clip((weights * q).sum() / max(weights.sum(), 1e-9), 0.01, 0.99))
        model = LabelModel(prior, np.array(rates), k + 1)
        new = model.posterior(votes)
        moved = float((weights * np.abs(new - q)).sum() / max(weights.sum(), 1e-9))
        q = new
        if moved < tolerance:
            break
    return model


def judge(counted: DataFrame, voters: dict[str, Column] | None = None) -> tuple[DataFrame, LabelModel]:
    """``counted`` with ``p_good``, the posterior, and the model.

    ``counted`` is read twice, so it should be a stored table.  The table of
    patterns has 3 ** rules rows at most and is broadcast.
    """
    voters = voters or rules()
    pattern = F.concat_ws(",", *(v.cast("string") for v in voters.values()))
    voted = counted.withColumn("_votes", pattern)
    found = voted.groupBy("_votes").count().collect()
    votes = np.array([[int(x) for x in r["_votes"].split(",")] for r in found], int).reshape(len(found), len(voters))
    model = fit(votes, np.array([r["count"] for r in found]))
    p = model.posterior(votes) if len(found) else np.zeros(0)
    spark = counted.sparkSession
    table = spark.createDataFrame([(r["_votes"], float(x)) for r, x in zip(found, p, strict=True)], "_votes string, p_good double")
    return voted.join(F.broadcast(table), "_votes", "left").drop("_votes"), model


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> tuple[DataFrame, LabelModel]:
    """(id, COUNTS..., p_good, good) of every row, and the model."""
    stored = materialise(counts(docs, id_col, text_col), "quality")
    judged, model = judge(stored)
    return judged.withColumn("good", F.col("p_good") >= threshold), model
