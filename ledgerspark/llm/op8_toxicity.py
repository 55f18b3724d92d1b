"""Operator 8: toxicity by weak supervision.

1. Voters, of both polarities and mixed quality.  Against a text: insults of a short general list, word beginnings of 3
   to 8 letters that stand out among toxic training rows (mined, so they follow the corpus and its languages) and
   patterns (shouting, runs of exclamation marks, insults addressed to "you").  For it: word beginnings that stand out
   among clean rows, licence lines, and the silence of all lexicon voters against it.
2. Label model.  A generative model of the votes given a hidden label: expectation-maximisation estimates how often each
   voter fires on either label.  The given label is one voter among them, whose accuracy is estimated as well.  Voters
   that stay correlated given the hidden label (nested word beginnings, say) are found from the residual covariance and
   share their weight, so that agreement among them counts once.
3. Classifier.  Logistic regression on the votes, trained on the label model's posteriors; rows count more the likelier
   they are toxic (``MISSED``).  It scores every text.

Voters are mined from, and the models fitted on, a bounded sample of labelled rows: at most ``SAMPLE`` ids of the
training folds, chosen by hash, one row each.  Scoring covers all rows.

Cases: null text is the empty text; texts without words get the score of their votes; an empty table gives an empty
result; without labelled rows of both kinds every score is 0; rows of unknown label only take part in scoring; null
labels and null ids count as unlabelled; an id with both labels counts as toxic; repeated rows are scored row by row;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, discard, map_batches, release, saved

#: Labelled rows that voters and models are fitted on, at most.
SAMPLE = 20_000
#: Mined voters of one polarity, at most (a classifier's size, not a filter of rows); lengths of word beginnings.
VOTERS, BEGINNINGS = 400, (3, 4, 5, 6, 7, 8)
#: A mined voter fires on this share of the rows of its side (and this many at least), its rates on the two sides differ
#: by this many standard errors, and this share of the sum of both rates is that of its side.
SUPPORT, LEAST, ERRORS = 0.01, 4, 6.0
AGAINST, FAVOUR = 0.9, 0.8
#: Trust in the given labels and the rows that it stands for; rows that a voter's equal rates stand for.
TRUST, TRUSTED, BELIEF = 0.9, 20.0, 10.0
THRESHOLD, MISSED = 0.7, 3.0
#: Word beginnings that a task counts before it hands the counts on.
HELD = 100_000
#: Insults of general use, voters whatever the labels say.
INSULTS = "idiot moron stupid dumb loser scum trash filth pathetic worthless disgusting clown imbecile cretin bastard bitch bullshit asshole arschloch dummkopf idioten miststück abschaum connard crétin salaud ordure imbécile cabrón gilipollas estúpido basura".split()

WORD = re.compile(r"[^\W\d_]+")
#: Patterns that vote against a text, and those that vote for it.
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{4,}\b\W+){3}"),
    "exclaiming": re.compile(r"!{2,}"),
    "addressed": re.compile(r"\b(?:you|u|your)\b[^.!?\n]{0,20}\b(?:are|re|so|such)\b", re.I),
}
FAVOURS = {
    "licensed": re.compile(r"\b(?:licen[sc]ed? under|all rights reserved|copyright)\b", re.I),
}


def beginnings(text: str) -> set[str]:
    """Word beginnings of a text."""
    return {w[:n] for w in set(WORD.findall(text.lower())) for n in BEGINNINGS if len(w) >= n}


class Voters:
    """Votes of a text: the numbers of the voters that fire.

    Order: lexicon against, patterns against, lexicon in favour, patterns in favour, silence of the lexicon against.
    """

    def __init__(self, against: list[str], favour: list[str]):
        self.against, self.favour = against, favour
        self.patterns = [*PATTERNS.values(), *FAVOURS.values()]
        self.numbers = [*range(len(against)), *range(len(against) + len(PATTERNS), len(against) + len(PATTERNS) + len(favour))]
        self.of_pattern = [*range(len(against), len(against) + len(PATTERNS)), *range(len(against) + len(PATTERNS) + len(favour), self.size - 1)]
        self.trie = ahocorasick.Automaton()
        for i, w in zip(self.numbers, [*against, *favour], strict=True):
            self.trie.add_word(w, (i, len(w)))
        if self.numbers:
            self.trie.make_automaton()

    @property
    def size(self) -> int:
        return len(self.against) + len(PATTERNS) + len(self.favour) + len(FAVOURS) + 1

    @property
    def polarity(self) -> np.ndarray:
        """1 for voters against a text, -1 for those in its favour."""
        return np.where(np.arange(self.size) < len(self.against) + len(PATTERNS), 1, -1)

    def votes(self, text: str) -> list[int]:
        got: set[int] = set()
        if self.numbers:
            low = text.lower()
            for end, (i, size) in self.trie.iter(low):
                at = end - size + 1
                if i not in got and (at == 0 or not low[at - 1].isalpha()):
                    got.add(i)
        if not any(i < len(self.against) for i in got):
            got.add(self.size - 1)
        got.update(i for i, p in zip(self.of_pattern, self.patterns, strict=True) if p.search(text))
        return sorted(got)


@dataclass
class LabelModel:
    """What the label model says: each voter's firing rates on toxic and clean rows, how many share its vote, and the
    given label's rates of saying toxic."""

    on_toxic: np.ndarray
    on_clean: np.ndarray
    share: np.ndarray
    given: tuple[float, float]
    prior: float

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        yes, no = self.given
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (np.log(self.on_toxic / self.on_clean) / self.share)
        odds += np.where(given == 1, np.log(yes / no), np.log((1 - yes) / (1 - no)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def label_model(votes: np.ndarray, given: np.ndarray, weight: np.ndarray, polarity: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation over rows by voters; ``weight``: rows with these votes, ``prior``: share of toxic rows.

    The given label is one more voter, right to ``TRUST`` as a start and as ``TRUSTED`` rows of belief.  A voter that does
    not fire abstains; its evidence is divided by how many of the voters that it is correlated with, given the hidden
    label, vote with it on average.
    """
    x = votes.astype(np.float64)
    prior = min(max(prior, 1e-3), 0.5)
    ones = np.ones(x.shape[1])
    # voters against a text start as thrice as frequent on toxic rows, those in its favour the other way round
    lean = np.where(polarity > 0, 3.0, 1 / 3)
    model = LabelModel(0.1 * lean, 0.1 * ones, np.maximum(1.0, x.sum(1).mean()) * ones, (TRUST, 1 - TRUST), prior)
    for step in range(rounds):
        post = model.posterior(x, given)
        w1, w0 = weight * post, weight * (1 - post)
        # before any row is seen, a voter fires as often on either label
        rate = (weight @ x + 1) / (weight.sum() + 2)
        p1, p0 = ((w @ x + BELIEF * rate) / (w.sum() + BELIEF) for w in (w1, w0))
        says = (w1 @ (given == 1) + TRUSTED * TRUST) / (w1.sum() + TRUSTED), (w0 @ (given == 1) + TRUSTED * (1 - TRUST)) / (w0.sum() + TRUSTED)
        share = model.share
        if step % 10 == 1:  # correlations that the hidden label does not explain
            centred = x - post[:, None] * p1 - (1 - post[:, None]) * p0
            cov = (centred * weight[:, None]).T @ centred / weight.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            related = (np.abs(cov / np.outer(sd, sd)) > 0.3) & np.equal.outer(polarity, polarity)
            together = (x * weight[:, None]).T @ x  # how many of a voter's relatives vote with it, itself included
            share = np.maximum(1, (together * related).sum(1) / np.maximum(weight @ x, 1))
        model = LabelModel(p1, p0, share, says, prior)
    return model


def fit_linear(votes: np.ndarray, weight: np.ndarray, target: np.ndarray, ridge: float = 0.005, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression of weighted rows on soft labels by Newton steps: (weights, intercept)."""
    x = np.hstack([votes.astype(np.float64), np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = -2.0
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    against: list[str]
    favour: list[str]
    weights: np.ndarray
    intercept: float
    labels: LabelModel | None = None

    def score(self, voters: Voters, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[voters.votes(text)].sum(), -30, 30))))


def stand_out(hits: dict[str, int], other: dict[str, int], n: int, m: int, precision: float) -> list[str]:
    """Word beginnings that fire much more often on ``n`` rows than on ``m`` others, the most telling first."""
    least, good = max(LEAST, int(n * SUPPORT)), {}
    for w, on in hits.items():
        a, b, p = on / n, other.get(w, 0) / m, (on + other.get(w, 0)) / (n + m)
        errors = (a - b) / max(1e-12, (p * (1 - p) * (1 / n + 1 / m)) ** 0.5)
        if on >= least and a / (a + b) >= precision and errors >= ERRORS:
            good[w] = a - b
    longest = {w: w for w in good}
    for v in sorted(good, key=lambda v: (len(v), v)):
        # as specific as it gets without losing rows: a longer beginning that is in as good as all the same rows
        for k in BEGINNINGS:
            if k < len(v) and v[:k] in good and hits[v] >= 0.98 * hits[v[:k]]:
                longest[v[:k]] = v
    chosen = {longest[w]: good[w] for w in good if not any(w[:k] in good for k in BEGINNINGS if k < len(w))}
    return sorted(chosen, key=lambda w: (-chosen[w], w))[:VOTERS]


def fit_votes(against: list[str], favour: list[str], votes: np.ndarray, given: np.ndarray, weight: np.ndarray, prior: float) -> Model:
    """Label model and classifier on distinct ballots (rows by voters) with given labels, and how often each was cast."""
    labels = label_model(votes, given, weight, Voters(against, favour).polarity, prior)
    posterior = labels.posterior(votes.astype(np.float64), given)
    # a toxic row that is missed weighs as much as ``MISSED`` false alarms
    return Model(against, favour, *fit_linear(votes, weight * (1 + (MISSED - 1) * posterior), posterior), labels)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit voters, label model and classifier on labelled rows outside the held-out fold."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_bucket(id_col, folds) != held))
    chosen = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` rows of (id, label), so the broadcast is bounded, and one row for each of them
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = saved(texts.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "labelled")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            words = sorted({*seen[0], *seen[1]})
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)], names=["word", "n0", "n1"])
            for c in seen:
                c.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(beginnings(text))
                seen[y][""] += 1
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield told()
        yield told()
        release()

    counted = saved(rows.mapInArrow(mine, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "beginnings")
    n_clean, n_toxic = counted.where("word = ''").agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    if not n_clean or not n_toxic:
        return Model([], [], np.zeros(Voters([], []).size), -30.0)
    # beginnings in 1 % of the rows of a side at least: 100 times those of a text at most
    common = (F.col("n0") >= max(LEAST, int(n_clean * SUPPORT))) | (F.col("n1") >= max(LEAST, int(n_toxic * SUPPORT)))
    found = {r.word: (r.n0, r.n1) for r in counted.where(common & (F.col("word") != "")).collect()}
    clean, toxic = ({w: n[y] for w, n in found.items()} for y in (0, 1))
    against = [*INSULTS, *(w for w in stand_out(toxic, clean, n_toxic, n_clean, AGAINST) if w not in INSULTS)]
    favour = [w for w in stand_out(clean, toxic, n_clean, n_toxic, FAVOUR) if w not in against]

    def cast(batch: pa.RecordBatch) -> pa.RecordBatch:
        voters = Voters(against, favour)
        return pa.RecordBatch.from_arrays([pa.array([voters.votes(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], names=["votes", "y"])

    # at most `sample` distinct ballots
    ballots = map_batches(rows, cast, "votes array<int>, y int").groupBy("votes", "y").agg(F.count("*").alias("n")).collect()
    discard(rows, counted)
    ballots.sort(key=lambda r: (r.votes, r.y))
    votes = np.zeros((len(ballots), Voters(against, favour).size), np.int8)
    for i, r in enumerate(ballots):
        votes[i, r.votes] = 1
    given, weight = np.array([r.y for r in ballots]), np.array([r.n for r in ballots], np.float64)
    return fit_votes(against, favour, votes, given, weight, n_toxic / (n_toxic + n_clean))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every row: (carried columns, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [id_col, *carry]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        voters = Voters(m.against, m.favour)
        scores = np.array([m.score(voters, t) for t in batch.column(len(kept)).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_text")), rows, f"{schema}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        voters = Voters(m.against, m.favour)
        return batch.filter(pa.array([m.score(voters, t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, rows, docs.schema)
