"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, text_of

_word = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Supervision:
    """terms: lexicon and pattern voters at most. precision and support: what a term needs, the share of its documents
    that are toxic and how many of those. sample: labelled rows that the label model and the classifier are fitted on,
    at most (documented bound; the terms are counted over all labelled rows). stems: word beginnings used as patterns.
    rounds, lean, copied, correlated: of the label model. ridge: of the classifier.
    """

    terms: int = 600
    precision: float = 0.8
    support: int = 3
    sample: int = 20_000
    stems: tuple[int, ...] = (4, 5, 6)
    rounds: int = 25
    lean: float = 2.0
    copied: float = 0.95
    correlated: float = 0.7
    ridge: float = 1.0


def terms_of(text: str, stems: tuple[int, ...]) -> set[str]:
    """The distinct lower-case words, and as pattern `xyz*` the beginnings of longer ones."""
    words = {w for run in {*text.lower().split()} for w in ((run,) if run.isalpha() else _word.findall(run))}
    return words | {w[:k] + "*" for k in stems for w in words if len(w) > k}


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def count_terms(labelled: DataFrame, rules: Supervision) -> DataFrame:
    """term, toxic, clean: in how many documents of each label; labelled: text, toxic. Counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            found = [*{**counts[0], **counts[1]}]
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([counts[y][t] for t in found], pa.int64()) for y in (1, 0))], names=["term", "toxic", "clean"])
            for c in counts:
                c.clear()
            return out

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[y].update(terms_of(text, rules.stems))
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield told()
        yield told()

    found = labelled.select("text", "toxic").mapInArrow(run, "term string, toxic bigint, clean bigint")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(counts: DataFrame, rules: Supervision) -> list[str]:
    """The terms with most toxic documents among those precise enough; at most rules.terms come to the driver."""
    sure = counts.where((F.col("toxic") >= rules.support) & (F.col("toxic") >= rules.precision * (F.col("toxic") + F.col("clean"))))
    return [r["term"] for r in sure.orderBy(F.desc("toxic"), "clean", "term").limit(rules.terms).collect()]


def correlations(v: np.ndarray, both: np.ndarray, classes: list[np.ndarray], least: float) -> np.ndarray:
    """Voters' correlations within classes, those under `least` as 0. classes: the rows' shares of each; they sum to 1."""
    spread = both.copy()  # the shares sum to 1, so only the means differ from class to class
    for p in classes:
        rate = _rates(v, p)
        cross = np.outer(p @ v, rate)
        spread += p.sum() * np.outer(rate, rate) - cross - cross.T
    scale = np.sqrt(np.clip(np.diag(spread), 1e-9, None))
    corr = np.clip(spread / scale[:, None] / scale[None, :], 0, 1)
    np.fill_diagonal(corr, 0)
    corr[corr < least] = 0
    return corr


def _rates(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.clip((p @ v + 0.05) / (p.sum() + 0.1), 1e-5, 1 - 1e-5)


def label_model(votes: np.ndarray, prior: float, rules: Supervision) -> np.ndarray:
    """P(toxic) of each row, from votes alone. votes: rows x voters, 1 or 0 (no opinion); prior: the share of toxic rows.

    Expectation-maximisation of a mixture of two classes with a rate of votes for each voter and class; the label of a row
    isn't an input. What ties the classes to their meaning is where the rounds begin: a vote leans to toxic by log odds of
    rules.lean, for every voter alike. Correlated voters share their say: each counts 1 / (1 + the sum of its correlations).
    Those of rules.copied or more over all rows count first, as good voters agree a lot but only copies nearly always; then
    those of rules.correlated or more within the classes found, with which the rounds go on.
    """
    v = votes.astype(float)
    if not len(v):
        return np.zeros(0)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    base, both = math.log(prior / (1 - prior)), v.T @ v
    q, classes = None, [np.ones(len(v))]
    for _ in range(3):
        say = 1 / (1 + correlations(v, both, classes, rules.copied if q is None else rules.correlated).sum(axis=1))
        if q is None:
            q = 1 / (1 + np.exp(-np.clip(base + rules.lean * (v @ say), -30, 30)))
        for _ in range(rules.rounds):
            rates = [_rates(v, p) for p in (q, 1 - q)]
            yes, no = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
            old, q = q, 1 / (1 + np.exp(-np.clip(base + v @ (say * yes) + (1 - v) @ (say * no), -30, 30)))
            if np.abs(q - old).max() < 1e-6:
                break
        classes = [q, 1 - q]
    return q


def linear_model(x: np.ndarray, q: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - q) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def features(terms: set[str], size: int, place: dict[str, int]) -> tuple[list[int], tuple[float, float]]:
    """Places of the lexicon terms found, and two totals: of their number, and of their share among the terms."""
    found = [place[t] for t in terms if t in place]
    return found, (math.log1p(len(found)), min(1.0, 20 * len(found) / max(1, size)))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", rules: Supervision | None = None) -> DataFrame:
    """key, held_out, score (0 to 1) of each whole text; labels: key, toxic.

    Labels are learned from rows that aren't held out, and tell two things: which terms are voters, counted over all of those,
    and the share of toxic rows. The label model has only the votes, and the classifier only its posteriors; both are fitted
    on at most rules.sample rows, those of least hash of the id. Only the text is an input of a score. Null and empty texts
    are scored as texts without words. Without any toxic labelled row, all scores are 0. Repeated rows are scored each, and
    repeated labels count as toxic if any is. Rows with a null id are scored and not held out. Other columns aren't read. An
    empty table gives no rows; texts of any length are read whole.
    """
    rules = rules or Supervision()
    known = labels.select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null AND key is not null").groupBy("key").agg(F.max(F.least("toxic", F.lit(1))).alias("toxic"))
    known = known.where(~held_out("key"))
    given = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(rules.sample)
    # rules.sample ids at most, and one text of each: of rows that repeat an id the least text
    few = given.join(F.broadcast(chosen), "key").groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    # the texts that aren't held out meet the labels by one shuffle at every size; the labels are hashed, so no text is sorted
    learned = given.where(~held_out("key")).join(known.hint("shuffle_hash"), "key")
    words = lexicon(count_terms(learned, rules), rules)
    place = {t: i for i, t in enumerate(words)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for b in batches:
            hits, totals = [], []
            for t in b.column(0).to_pylist():
                own = terms_of(t, rules.stems)
                at, more = features(own, len(own), place)
                hits.append(at)
                totals.append(list(more))
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), pa.array(totals, pa.list_(pa.float64())), b.column(1)], names=["hits", "totals", "toxic"])

    weights, bias = np.zeros(len(words) + 2), -30.0
    if words:
        rows = few.mapInArrow(found, "hits array<int>, totals array<double>, toxic int").collect()
        x = np.zeros((len(rows), len(words) + 2))
        for i, r in enumerate(rows):
            x[i, r["hits"]] = 1
            x[i, -2:] = r["totals"]
        posterior = label_model(x[:, : len(words)], sum(r["toxic"] for r in rows) / max(1, len(rows)), rules)
        weights, bias = linear_model(x, posterior, rules.ridge)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                own = terms_of(t, rules.stems)
                at, more = features(own, len(own), place)
                z = bias + float(weights[at].sum()) + float(weights[-2] * more[0] + weights[-1] * more[1])
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = given.mapInArrow(score, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), F.coalesce(held_out("key"), F.lit(False)).alias("held_out"), "score")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The contract's columns: score_toxicity's, and predicted (int), 1 from the threshold on; odd rows are as there."""
    scored = score_toxicity(docs, labels)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
