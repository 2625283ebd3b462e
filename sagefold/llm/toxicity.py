"""Toxicity by weak supervision.

1. Voters.  Lexicon voters (a word is there) and pattern voters (a word with
   this beginning is there) are mined from a bounded sample of labelled rows;
   seed voters stand for groups of common English insults.  One more voter takes
   the opposite side: no suspect word at all.
2. Label model.  One pass over *all* documents counts the combinations of votes.
   Expectation-maximisation over them gives each voter's rate on toxic and on
   clean documents, that is its accuracy; what the fit leaves over between two
   voters is their correlation, by which correlated votes count less.
3. Classifier.  A bounded sample of documents (``sample``) gets posterior labels
   from the label model; a linear classifier over words and beginnings of words
   (the ``FEATURES`` that tell most of toxic ones) is trained on them, so that
   words outside the lexicon count too.
4. Every whole text is scored with the classifier's weights.

Labels come only from rows that ``may_learn`` lets through.  Label, language,
source and id are no inputs of a score.

Null and empty texts have no words and get the score of the intercept.  Without
any label the seeds alone vote.  Repeated rows each get their score.  An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, materialise, texts

#: Labelled rows from which voters are mined, and further rows on which the classifier is trained, at most.
LABELLED, SAMPLE = 6000, 6000
#: Terms that the classifier weighs at most.
FEATURES = 6000
#: Mined voters at most (votes are the bits of a long), and how much more frequent their terms are on toxic rows at least.
VOTERS, LIFT = 56, 5.0
#: Lengths of the beginnings of words.
PREFIXES = (4, 5, 6)

# Common English insults by group; each group is one voter.
SEEDS = {
    "stupidity": ["idiot", "moron", "stupid", "dumb", "imbecile", "fool"],
    "contempt": ["loser", "pathetic", "worthless", "clown", "useless"],
    "disgust": ["scum", "trash", "disgusting", "garbage", "filth", "vermin"],
}

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """The text's distinct words in lower case (``w:``), and beginnings that one, two or three of its longer words have (``p:``, ``2:``, ``3:``)."""
    words = set(_WORD.findall(text.lower()))
    found = {f"w:{w}" for w in words}
    for n in PREFIXES:
        for start, many in Counter([w[:n] for w in words if len(w) > n]).items():
            found.add(f"p:{start}")
            if many > 1:
                found.add(f"2:{start}")
            if many > 2:
                found.add(f"3:{start}")
    return found


@dataclass
class Voters:
    """names[i] is term i's voter; a voter votes where one of its terms is there.  The last voter votes where no other does."""

    terms: dict[str, int]
    n: int

    def vote(self, found: set[str]) -> np.ndarray:
        out = np.zeros(self.n + 1, np.int8)
        for t in found & self.terms.keys():
            out[self.terms[t]] = 1
        out[self.n] = not out[: self.n].any()
        return out


def mine(counted: DataFrame, n_bad: int, n_good: int, most: int = VOTERS) -> Voters:
    """Terms that are surely more frequent on toxic rows; seeds besides.

    ``counted``: (term, bad, good), the rows of each class that have the term.
    Of terms with the same first four letters the one with the largest G statistic
    votes: words and their beginnings would only repeat each other.  A term counts
    if its rate on toxic rows, less two deviations, is ``LIFT`` times that on clean
    ones.
    """
    by_term: dict[str, int] = {}
    for k, words in enumerate(SEEDS.values()):
        by_term.update({f"w:{w}": k for w in words})
    n = len(SEEDS)
    base = (n_bad + 0.5) / (n_bad + n_good + 1)
    share = (F.col("bad") + 0.5) / (F.col("bad") + F.col("good") + 1)
    gain = F.col("bad") * F.log(share / base) + F.col("good") * F.log((1 - share) / (1 - base) + 1e-9)
    low = (F.col("bad") - 2 * F.sqrt("bad")) / max(n_bad, 1)
    fit = (F.col("bad") >= 5) & (low >= LIFT * (F.col("good") + 1) / max(n_good, 1)) & ~F.col("term").isin(list(by_term))
    best = counted.filter(fit).withColumn("gain", gain).groupBy(F.substring("term", 3, 4).alias("stem")).agg(F.max(F.struct("gain", "term")).alias("x"))
    for r in best.select("x.gain", "x.term").orderBy(F.desc("gain"), "term").limit(most).collect():
        by_term[r["term"]] = n
        n += 1
    return Voters(by_term, n)


@dataclass
class LabelModel:
    """a, b: each voter's rate on toxic and on clean documents; weight: its share after correlations."""

    prior: float
    a: np.ndarray
    b: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray = field(repr=False)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on, off = np.log(self.a / self.b), np.log((1 - self.a) / (1 - self.b))
        odds = np.log(self.prior / (1 - self.prior)) + (votes * on + (1 - votes) * off) @ self.weight
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def accuracies(self) -> np.ndarray:
        """The share of toxic documents among those where a voter votes (for the last one: of clean ones)."""
        hit, miss = self.prior * self.a, (1 - self.prior) * self.b
        share = hit / (hit + miss)
        share[-1] = 1 - share[-1]
        return share


def _sums(stored: DataFrame, width: int, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all patterns of ``work``(votes as rows of 0 and 1, counts), which gives ``width`` numbers for a batch.

    Each batch becomes one row; a plan that stays the same from round to round
    needs no new code.
    """

    def make():
        def step(masks: pa.Array, counts: pa.Array) -> list:
            votes = masks.to_numpy()[:, None] >> np.arange(64) & 1
            total = work(votes.astype(float), counts.to_numpy().astype(float))
            return [[total.tolist()] + [None] * (len(masks) - 1) if len(masks) else []]

        return step

    rows = map_columns(stored, [], ["mask", "n"], T.StructType([T.StructField("sums", T.ArrayType(T.DoubleType()))]), make)
    each = rows.filter("sums is not null").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in each:
        out[r["k"]] = r["v"]
    return out


def fit_labels(stored: DataFrame, m: int, known: tuple[float, np.ndarray, np.ndarray], rounds: int = 12) -> LabelModel:
    """The label model over all documents' votes.

    ``stored``: (mask, n), the distinct combinations of votes with their counts,
    however many there are; each round of expectation-maximisation is one
    aggregation of them.  ``known``: prior and rates on the labelled rows, which
    count as much as the unlabelled ones of their class: they keep the classes'
    meaning.  What two voters share beyond the fit is their correlation.
    """
    p, a0, b0 = known
    a, b = a0.copy(), b0.copy()
    both = _sums(stored, m * m + 1, lambda v, n: np.append((v[:, :m].T * n) @ v[:, :m], n.sum()))
    n, both = both[-1], both[:-1].reshape(m, m)
    if not n:
        return LabelModel(p, a, b, np.ones(m), np.zeros((m, m)))
    hits, low, high = np.diag(both).copy(), 1e-5, 1 - 1e-5
    for _ in range(rounds):
        on, off = np.log(a / b), np.log((1 - a) / (1 - b))
        base = np.log(p / (1 - p)) + off.sum()

        def work(v: np.ndarray, count: np.ndarray, base: float = base, weights: np.ndarray = on - off) -> np.ndarray:
            q = count / (1 + np.exp(-np.clip(base + v[:, :m] @ weights, -500, 500)))
            return np.append(q @ v[:, :m], q.sum())

        found = _sums(stored, m + 1, work)
        toxic, on_toxic = found[-1], found[:-1]
        new_a = np.clip((on_toxic + toxic * a0) / (2 * toxic + 1e-9), low, high)
        new_b = np.clip((hits - on_toxic + (n - toxic) * b0) / (2 * (n - toxic) + 1e-9), low, high)
        moved = max(np.abs(new_a - a).max(), np.abs(new_b - b).max())
        a, b, p = new_a, new_b, float(np.clip(toxic / n, 0.2 * known[0], min(0.6, 5 * known[0])))
        if moved < 1e-4:
            break
    first = hits / n
    left = both / n - p * np.outer(a, a) - (1 - p) * np.outer(b, b)
    spread = np.sqrt(np.outer(first * (1 - first), first * (1 - first))) + 1e-9
    correlation = np.clip(left / spread, -1, 1) * (1 - np.eye(m))
    strong = np.where(correlation > 0.1, correlation, 0.0)
    return LabelModel(p, a, b, 1 / (1 + strong.sum(1)), correlation)


@dataclass
class Classifier:
    """A linear classifier over terms that are there."""

    weights: dict[str, float]
    bias: float

    def score(self, found: set[str]) -> float:
        z = self.bias + sum(self.weights[t] for t in found & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(rows: list[np.ndarray], labels: np.ndarray, names: list[str], start: dict[str, float], rounds: int = 150, rate: float = 0.5, ridge: float = 2e-4) -> Classifier:
    """Logistic regression on soft labels by Adagrad over all rows.

    ``rows``: the places in ``names`` of the terms that each row has; weights
    begin with ``start`` and stay at 0 or above: no number of harmless words makes
    up for an insult, so that a text's length does not decide.
    """
    w = np.array([max(0.0, start.get(t, 0.0)) for t in names])
    flat = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in rows])
    bias, g2, b2 = -2.0, np.full(len(names), 1e-2), 1e-2
    for _ in range(rounds if len(rows) else 0):
        z = bias + np.bincount(owner, w[flat], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels
        g = np.bincount(flat, error[owner], len(names)) / len(rows) + ridge * w
        gb = float(error.mean())
        g2 += g * g
        b2 += gb * gb
        w = np.maximum(0.0, w - rate * g / np.sqrt(g2))
        bias -= rate * gb / np.sqrt(b2)
    return Classifier({t: float(x) for t, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(bias))


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    classifier: Classifier


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """(_id, _h, _y) of ``most`` rows at most, by a hash of their text, so that reruns agree; one row of each text."""
    return rows.groupBy("_h").agg(F.min("_id").alias("_id"), F.max("_y").alias("_y")).orderBy("_h").limit(most)


def _with_terms(rows: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    add = T.StructType([T.StructField("terms", T.ArrayType(T.StringType()))])
    return map_columns(rows, keep, [text_col], add, lambda: lambda c: [[sorted(terms(x)) for x in texts(c)]])


def _posteriors(pool: DataFrame, voters: Voters, model: LabelModel) -> DataFrame:
    """(q, terms): the pool with posterior labels."""

    def make():
        def step(column: pa.Array) -> list:
            votes = np.array([voters.vote(set(x)) for x in column.to_pylist()], float).reshape(-1, voters.n + 1)
            return [model.posterior(votes)]

        return step

    return map_columns(pool, ["terms"], ["terms"], T.StructType([T.StructField("q", T.DoubleType())]), make)


def _votes(rows: DataFrame, voters: Voters) -> DataFrame:
    """(_y, v): the votes on rows of (_y, terms)."""
    add = T.StructType([T.StructField("v", T.ArrayType(T.IntegerType()))])
    return map_columns(rows, ["_y"], ["terms"], add, lambda: lambda c: [[voters.vote(set(x)).tolist() for x in c.to_pylist()]])


def patterns(docs: DataFrame, voters: Voters, text_col: str) -> DataFrame:
    """(mask, n): each combination of votes on a document, as bits, with its count; over all documents."""
    weights = 1 << np.arange(voters.n + 1, dtype=np.int64)

    def make():
        return lambda column: [[int(voters.vote(terms(x)).astype(np.int64) @ weights) for x in texts(column)]]

    masks = map_columns(docs, [], [text_col], T.StructType([T.StructField("mask", T.LongType())]), make)
    return materialise(masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n")), "votes")


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, sample: int = SAMPLE) -> Model:
    """Voters, label model and classifier.  ``may_learn``: a condition on the id; other rows' labels are never read."""
    known = labels.filter(may_learn).filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    texts_of = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text")).withColumn("_h", F.xxhash64("_text"))
    base = texts_of.filter(may_learn).withColumnRenamed(id_col, "_id")
    hashes = materialise(base.select("_id", "_h"), "hashes")
    marked = hashes.join(known.select(F.col(id_col).alias("_id"), (F.col("_y") > 0).cast("int").alias("_y")), "_id")
    halves = [_sample(marked.filter(F.col("_y") == y), labelled // 2) for y in (0, 1)]
    corpus = _sample(hashes.withColumn("_y", F.lit(None).cast("int")), sample)
    # the samples have bounded numbers of rows: their ids are broadcast, texts do not travel
    chosen = materialise(halves[0].unionByName(halves[1]).unionByName(corpus), "sample")
    taken = materialise(_with_terms(base.join(F.broadcast(chosen), ["_id", "_h"]), ["_y"], "_text"), "labelled")
    learned, more = taken.filter("_y is not null"), taken.filter("_y is null")
    n_of = {r["_y"]: r["count"] for r in learned.groupBy("_y").count().collect()}
    counted = learned.select("_y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("_y").alias("bad"), F.sum(1 - F.col("_y")).alias("good"))
    voters = mine(counted, n_of.get(1, 0), n_of.get(0, 0))
    m = voters.n + 1
    rates = {r["_y"]: np.array(r["v"], float) for r in _votes(learned, voters).groupBy("_y").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(m))).alias("v")).collect()}
    all_known = {r["bad"]: r["count"] for r in known.groupBy((F.col("_y") > 0).alias("bad")).count().collect()}
    prior = float(np.clip((all_known.get(True, 0) + 1) / (sum(all_known.values()) + 10), 0.005, 0.5))
    a = (rates[1] + 0.1) / (n_of[1] + 1.0) if 1 in rates else np.r_[np.full(m - 1, 0.2), 0.2]
    b = (rates[0] + 0.1) / (n_of[0] + 1.0) if 0 in rates else np.r_[np.full(m - 1, 0.01), 0.97]
    model = fit_labels(patterns(docs, voters, text_col), m, (prior, np.clip(a, 1e-4, 0.999), np.clip(b, 1e-4, 0.999)))
    # the labelled sample brings enough toxic rows, the other one the corpus
    pool = materialise(_posteriors(learned.unionByName(more).select("terms"), voters, model), "pool")
    mean = pool.agg(F.avg("q")).first()[0] or 0.0
    # deviations by which a term's posterior labels exceed the mean
    tilt = (F.col("q") - F.col("n") * mean) / F.sqrt(F.col("n") * max(mean * (1 - mean), 1e-9))
    weighed = pool.select("q", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 3).filter(tilt > 3)
    names = sorted({r["term"] for r in weighed.orderBy(F.desc(tilt), "term").limit(FEATURES).select("term").collect()} | voters.terms.keys())
    place = {t: i for i, t in enumerate(names)}
    index = map_columns(pool, ["q"], ["terms"], T.StructType([T.StructField("at", T.ArrayType(T.IntegerType()))]), lambda: lambda c: [[[place[t] for t in x if t in place] for x in c.to_pylist()]])
    rows = [(r["q"], np.array(r["at"], np.int32)) for r in index.collect()]
    strength = np.log(model.a / model.b) * model.weight
    start = {t: float(np.clip(strength[k], 0, 8)) for t, k in voters.terms.items()}
    return Model(voters, model, train([x for _, x in rows], np.array([q for q, _ in rows]), names, start))


def score(docs: DataFrame, classifier: Classifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score`` (0 to 1) of every row's whole text."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(classifier)  # bounded by the sample's terms

    def make():
        model = shared.value
        words = {t[2:]: w for t, w in model.weights.items() if t[0] == "w"}
        starts: dict[str, list[float]] = {}
        for t, w in model.weights.items():
            if t[0] != "w":
                starts.setdefault(t[2:], [0.0] * 3)["p23".index(t[0])] = w
        weighed = starts.__contains__

        def step(column: pa.Array) -> list:
            out = []
            for text in texts(column):
                found = set(_WORD.findall(text.lower()))
                z = model.bias + sum(words[w] for w in sorted(found & words.keys()))
                for n in PREFIXES:
                    some = Counter(filter(weighed, [w[:n] for w in found if len(w) > n]))
                    z += sum(sum(starts[p][: min(k, 3)]) for p, k in sorted(some.items()))
                out.append(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))))
            return [out]

        return step

    return map_columns(docs, keep, [text_col], T.StructType([T.StructField("score", T.DoubleType())]), make)


def learnable(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))
