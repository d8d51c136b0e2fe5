"""Toxicity scores by a counterfactually regularised linear classifier.

A document is the set of its lower-cased words and of their first letters. A logistic model with
an L1 penalty is fitted on labelled documents. To keep neutral mentions of groups from counting
as toxic, identity terms in labelled sentences are swapped for the terms of other groups, and the
squared change of the score's logit is penalised: what a sentence says about one group has to weigh the
same about any other.

The fit uses at most ``max_labelled`` labelled rows, taken by a hash of their identifier, and at
most ``max_features`` features; both bounds are parameters. The labels are sent to the documents,
never the documents to the labels, and the driver gets feature numbers only. Scoring reads every
whole text in place: no shuffle.

Defined results: null and empty texts score as documents without features; without usable labels
the score is 0 for all; a label for an unknown document is unused; a document with several labels is
toxic if one says so; rows that repeat a labelled identifier count once, with the greatest text; a null
identifier is not held out and has no label; other columns are carried along as struct ``document``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import stored, text_of

MAX_LABELLED = 20_000
MAX_FEATURES = 20_000
MIN_DOCUMENTS = 4
#: Times 1 / sqrt(examples): noise in the loss falls at that rate.
PENALTY = 0.03
FAIRNESS = 1.0
ROUNDS = 300
THRESHOLD = 0.3
FOLDS = 4
HELD_OUT = 2
REMEMBERED = 200_000
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)

# Identity terms by kind; terms in the same place of a row are forms of one another. Fixed values.
IDENTITY_TERMS = (
    ("people", "persons", "citizens", "neighbours"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("immigrant", "refugee", "foreigner", "local", "native"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
)
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def features(words: set[str]) -> set[str]:
    found = set(words)
    for size in PREFIXES:
        found.update(f"{w[:size]}~" for w in words if len(w) >= size)
    return found


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swapped_sentences(text: str, terms=IDENTITY_TERMS) -> Iterator[tuple[list[str], list[str]]]:
    """The words of every sentence that has identity terms, and the same with each exchanged for another group's."""
    group = {t: row for row in terms for t in row}
    low = text.lower()
    if not any(t in low for t in group):
        return
    for sentence in SENTENCE.finditer(low):
        words = WORD.findall(sentence[0])
        shift = 1 + sum(w in group for w in words) % 2
        other = [group[w][(group[w].index(w) + shift) % len(group[w])] if w in group else w for w in words]
        if other != words:
            yield words, other


def swap_changes(text: str, terms=IDENTITY_TERMS) -> Counter:
    """By what swapping the terms of one sentence takes from the features of the text and what it adds, the number
    of such sentences. The words of the text are counted once, so time is linear in its length."""
    words = Counter(WORD.findall(text.lower()))
    holders = Counter(f for w in words for f in features({w}))
    changes: Counter = Counter()
    for old, new in swapped_sentences(text, terms):
        less, more = Counter(old), Counter(new)
        gone = [w for w in less if words[w] - less[w] + more[w] == 0]
        come = [w for w in more if w not in words]
        left, gained = Counter(f for w in gone for f in features({w})), Counter(f for w in come for f in features({w}))
        taken = tuple(sorted(f for f, n in left.items() if holders[f] - n + gained[f] == 0))
        added = tuple(sorted(f for f in gained if f not in holders))
        changes[taken, added] += 1
    return changes


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def scorer(self):
        """Text to score; which features a word brings is remembered, up to a bound."""
        memory: dict[str, tuple] = {}

        def score(text: str) -> float:
            found: set[str] = set()
            if len(memory) > REMEMBERED:
                memory.clear()
            for word in words_of(text):
                known = memory.get(word)
                if known is None:
                    known = memory[word] = tuple(f for f in features({word}) if f in self.weights)
                found.update(known)
            logit = self.bias + sum(self.weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))

        return score


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """``id, text, label`` of at most ``limit`` labelled documents outside the held-out fold."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.join(F.broadcast(some), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def _example_features(sample: DataFrame, wanted: dict[str, int] | None, terms) -> DataFrame:
    """``key, label, n, features, added``: for the document ``n`` is 0; for swaps, the number of sentences that take
    ``features`` and bring ``added``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, label in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "label"))):
                if wanted is None:
                    rows.append((key, label, 0, sorted(features(words_of(text))), []))
                    continue
                rows.append((key, label, 0, sorted(wanted[f] for f in features(words_of(text)) if f in wanted), []))
                changes: Counter = Counter()
                for parts, n in swap_changes(text, terms).items():
                    changes[tuple(tuple(sorted(wanted[f] for f in part if f in wanted)) for part in parts)] += n
                rows += [(key, label, n, *parts) for parts, n in sorted(changes.items())]
            kind = pa.list_(pa.string() if wanted is None else pa.int32())
            kinds = (pa.int64(), pa.int32(), pa.int32(), kind, kind)
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "label", "n", "features", "added"])

    kind = "string" if wanted is None else "int"
    numbered = sample.select(F.xxhash64("id").alias("key"), "text", "label")
    return numbered.mapInArrow(run, f"key bigint, label int, n int, features array<{kind}>, added array<{kind}>")


def choose_features(sample: DataFrame, terms, limit: int, least: int) -> list[str]:
    """Features that tell the labels apart best, and all identity terms among them."""
    counted = (
        _example_features(sample, None, terms)
        .select("label", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
        .filter(F.col("n") >= least)
    )
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    if not totals["n"] or not totals["toxic"]:
        return []
    share = totals["toxic"] / totals["n"]
    z = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    best = counted.orderBy(F.desc(z), "feature").limit(limit).select("feature").collect()
    every_term = {t for row in terms for t in row}
    return sorted({r[0] for r in best} | every_term)


class _Sparse:
    """Rows of feature numbers with a common value each. Held in four bytes a number; ``PART`` rows at a time are spread out."""

    PART = 1000

    def __init__(self, rows: list[tuple[list[int], float]]):
        self.sizes = np.array([len(r) for r, _ in rows], dtype=np.int64)
        self.ids = np.concatenate([np.array(r, dtype=np.int32) for r, _ in rows]) if rows else np.zeros(0, np.int32)
        self.values = np.array([v for _, v in rows], dtype=float)
        self.rows = len(rows)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).tolist()

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last row, the feature numbers of the rows between, and the row of each, from 0."""
        for low in range(0, self.rows, self.PART):
            high = min(low + self.PART, self.rows)
            of = np.repeat(np.arange(high - low), self.sizes[low:high])
            yield low, high, self.ids[self.starts[low] : self.starts[high]].astype(np.int64), of

    def times(self, theta: np.ndarray) -> np.ndarray:
        found = np.zeros(self.rows)
        for low, high, ids, of in self.parts():
            found[low:high] = np.bincount(of, weights=theta[ids] * self.values[low:high][of], minlength=high - low)
        return found

    def back(self, residual: np.ndarray, width: int) -> np.ndarray:
        found = np.zeros(width)
        for low, high, ids, of in self.parts():
            np.add.at(found, ids, (residual[low:high] * self.values[low:high])[of])  # one after the other, as if in one piece
        return found


def fit(examples: list[tuple[list[int], int]], changes: list[list[tuple[list[int], float]]], width: int,
        penalty: float = PENALTY, fairness: float = FAIRNESS, rounds: int = ROUNDS, swaps: int | None = None) -> tuple[float, np.ndarray]:
    """Bias and weights: logistic loss, L1 penalty and squared logit changes of the swaps, by accelerated
    proximal gradient steps. A change is a list of (features, value) parts; one that stands for n equal ones has
    its values times the root of n, and ``swaps`` is the number of all."""
    x = _Sparse([(f, 1.0) for f, _ in examples])
    y = np.array([label for _, label in examples], dtype=float)
    parts = [(f, v, k) for k, change in enumerate(changes) for f, v in change]
    d, owner = _Sparse([(f, v) for f, v, _ in parts]), np.array([k for *_, k in parts], dtype=np.int64)
    n, m = max(len(examples), 1), max(swaps or len(changes), 1)
    penalty /= np.sqrt(n)

    def swap_change(theta):
        return np.bincount(owner, weights=d.times(theta), minlength=len(changes)) if len(changes) else np.zeros(0)

    def gradient(theta, bias):
        residual = 1 / (1 + np.exp(-np.clip(x.times(theta) + bias, -40, 40))) - y
        step = x.back(residual, width) / n
        if len(changes):
            step += 2 * fairness / m * d.back(swap_change(theta)[owner], width)
        return step, residual.mean()

    # The largest curvature, by power steps; 0.25 bounds the second derivative of the logistic loss.
    probe, curvature = np.ones(width), 1.0
    for _ in range(15):
        new = x.back(x.times(probe) + probe.mean(), width) / (4 * n)
        if len(changes):
            new += 2 * fairness / m * d.back(swap_change(probe)[owner], width)
        curvature = np.linalg.norm(new) / max(np.linalg.norm(probe), 1e-12)
        probe = new / max(np.linalg.norm(new), 1e-12)
    rate = 1 / (1.3 * curvature + 0.5)
    theta = look = np.zeros(width)
    prior = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
    bias = bias_look = float(np.log(prior / (1 - prior)))
    momentum = 1.0
    for _ in range(rounds):
        step, bias_step = gradient(look, bias_look)
        new = look - rate * step
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias = bias_look - rate * bias_step
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        look, bias_look = new + pull * (new - theta), new_bias + pull * (new_bias - bias)
        theta, bias, momentum = new, new_bias, following
    return float(bias), theta


def _numbers(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of one array: four bytes a number."""
    lists = column.combine_chunks()
    return np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(lists) else []


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          terms=IDENTITY_TERMS, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES,
          min_documents: int = MIN_DOCUMENTS, penalty: float = PENALTY, fairness: float = FAIRNESS) -> Model | None:
    """The fitted model; None without toxic labels."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_labelled)
    names = choose_features(sample, terms, max_features, min_documents)
    if not names:
        return None
    number = {f: i for i, f in enumerate(names)}
    rows = stored(_example_features(sample, number, terms), "example-features")
    examples = rows.filter("n = 0").select("key", "features", "label").orderBy("key").toArrow()
    # Equal changes of all documents are one row: no more than there are kinds of swaps, whatever the texts.
    changes = rows.filter("n > 0").groupBy("features", "added").agg(F.sum("n").alias("n")).orderBy("features", "added").toArrow()
    times = changes["n"].to_pylist()
    parts = [[(a, n**0.5), (b, -(n**0.5))] for a, b, n in zip(_numbers(changes["features"]), _numbers(changes["added"]), times)]
    known = list(zip(_numbers(examples["features"]), examples["label"].to_pylist()))
    bias, weights = fit(known, parts, len(names), penalty, fairness, swaps=sum(times))
    return Model(bias, {f: float(w) for f, w in zip(names, weights) if w})


def toxicity_scores(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``document`` (all columns, without the text unless asked for) and ``score``."""
    kept = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("document"), text_of(text_col).alias("text"))
    if model is None:
        return rows.select("document", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scored = sent.value.scorer()
        for texts in batches:
            yield texts.map(scored)

    return rows.select("document", score("text").alias("score"))


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, unchanged."""
    return toxicity_scores(docs, model, text_col, keep_text=True).filter(F.col("score") < threshold).select("document.*")
