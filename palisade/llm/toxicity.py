"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is a logistic function of the words and word beginnings that it holds; the noisy-or of its
sentences, 1 - prod(1 - p), is the document's. Only documents carry labels, so the weights are fitted to them through the
noisy-or, and the sentence probabilities that come out tell where the offence is. The features are those whose document
frequency is surely higher among toxic documents.

The model is fitted on a bounded sample: the `sample` labelled ids with the smallest hashes, of all with crc32(id as
text) mod 5 other than 0; of their documents, those longer than LONGEST characters teach nothing. Every document is
scored over its whole text.

Defined cases: a null or empty text has no sentences and scores 0; repeated rows score alike; an id that repeats with
different texts teaches by the first of them in binary order; labels that repeat count once by their largest value, null
labels not at all; a null id is held out; without both labels every score is 0. Only id and text are used, so other
columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import by_value

by_value(__name__)
#: Training documents, features, documents that hold a feature, and standard errors of its excess in toxic ones.
SAMPLE, FEATURES, LEAST, SURE = 3000, 3000, 4, 4.0
LONGEST = 100_000
ROUNDS, RATE, SHRINK, START = 300, 0.1, 0.05, -6.0
#: Lengths of word beginnings; words remembered by a worker.
STEMS, REMEMBERED = (3, 7), 500_000
SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def parts(word: str) -> list[str]:
    """Features of a word: itself, and its beginnings (marked by a hyphen), which inflected forms share."""
    return [word, *(word[:n] + "-" for n in range(STEMS[0], min(len(word), STEMS[1]) + 1))]


class Known(dict):
    """Word to those of its features that have a weight; filled as words are met, and emptied when it is full."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(x for x in parts(word) if x in self.weights)
        return found


class Model:
    """Weights of words and word beginnings, and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias, self.known = weights, bias, Known(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def evidence(self, sentence: str) -> float | None:
        """Log-odds of a lower-cased sentence; None if nothing in it is known."""
        found = set().union(*set(map(self.known.__getitem__, WORD.findall(sentence))))
        return self.bias + sum(self.weights[x] for x in sorted(found)) if found else None

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence, in code points."""
        found = ((m, self.evidence(m[0].lower())) for m in SENTENCE.finditer(text))
        return [(m.start(), m.end(), float(1 / (1 + np.exp(-(self.bias if z is None else z))))) for m, z in found]

    def score(self, text: str) -> float:
        """Noisy-or over the sentences."""
        if not self.weights:
            return 0.0
        log_clean, plain = 0.0, 0
        for s in SENTENCE.findall(text.lower()):
            z = self.evidence(s)
            if z is None:
                plain += 1
            else:
                log_clean += float(np.logaddexp(0.0, z))
        return float(-np.expm1(-log_clean - plain * float(np.logaddexp(0.0, self.bias))))


@dataclass
class Bags:
    """Documents as bags of sentences: entry i says that sentence rows[i] holds feature cols[i]; sentence s is of document
    doc[s]; plain counts the other sentences of a document, which are all alike; y has the labels."""

    rows: np.ndarray
    cols: np.ndarray
    doc: np.ndarray
    plain: np.ndarray
    y: np.ndarray

    def loss(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """Mean loss (negative log-likelihood of the labels and a pull on the weights) and its gradient by w and b."""
        z = b + np.bincount(self.rows, w[self.cols], len(self.doc))
        p, p_plain = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        clean = np.bincount(self.doc, np.logaddexp(0, z), len(self.y)) + self.plain * np.logaddexp(0, b)  # -log P(no sentence)
        clean = np.maximum(clean, 1e-9)
        toxic = -np.expm1(-clean)
        value = ((1 - self.y) * clean - self.y * np.log(toxic)).sum() + SHRINK / 2 * (w * w).sum()
        slope = (1 - self.y) - self.y * np.exp(-clean) / toxic
        by_sentence = slope[self.doc] * p
        by_w = np.bincount(self.cols, by_sentence[self.rows], len(w)) + SHRINK * w
        by_b = by_sentence.sum() + (slope * self.plain).sum() * p_plain
        return value / len(self.y), np.append(by_w, by_b) / len(self.y)


def train(texts: list[str], labels: list[int], features: int = FEATURES, least: int = LEAST, gap: float = SURE) -> Model:
    """Fit by full-batch Adam on the log-likelihood of the document labels, with an L2 pull on the weights."""
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, START)
    split = [[set(WORD.findall(s)) for s in SENTENCE.findall((t or "").lower())] for t in texts]
    seen = [Counter(), Counter()]
    for sentences, label in zip(split, labels, strict=True):
        seen[int(label)].update({x for w in set().union(*sentences) for x in parts(w)})
    n1, n0 = y.sum(), (1 - y).sum()
    excess = {}
    for x, n in seen[1].items():
        all_ = n + seen[0][x]
        p = all_ / (n1 + n0)
        z = (n / n1 - seen[0][x] / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        if all_ >= least and z >= gap:  # standardised difference of the shares of documents that hold the feature
            excess[x] = z
    names = sorted(sorted(excess), key=excess.get, reverse=True)[:features]
    number = {x: i for i, x in enumerate(names)}
    rows, cols, doc = [], [], []
    plain = np.zeros(len(y))  # sentences of a document without features, as many alike
    for d, sentences in enumerate(split):
        for s in sentences:
            if known := {number[x] for w in s for x in parts(w) if x in number}:
                rows += [len(doc)] * len(known)
                cols += sorted(known)
                doc.append(d)
            else:
                plain[d] += 1
    bags = Bags(*(np.array(x, np.int64) for x in (rows, cols, doc)), plain, y)
    w, b = np.zeros(len(names)), START
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, ROUNDS + 1):
        _, grad = bags.loss(w, b)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({x: float(w[i]) for x, i in number.items()}, float(b))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    marks = labels.filter("toxic IS NOT NULL").filter(~held_out(F.col(key))).groupBy(F.col(key).alias("_k")).agg(F.max("toxic").alias("_y"))
    marks = marks.filter("_k IS NOT NULL").withColumn("_h", F.xxhash64("_k"))
    # tasks send no more than their share of the ids, and a little; at most `sample` ids are chosen
    share = min(1.0, 1.5 * sample / max(1, marks.count()) + 1e-5)
    chosen = marks.filter(F.pmod("_h", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.pmod("_h", F.lit(1 << 30)), "_k").limit(sample)
    some = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter(F.coalesce(F.length("_t"), F.lit(0)) <= LONGEST)
    rows = some.join(F.broadcast(chosen), "_k").groupBy("_k", "_y").agg(F.min(F.coalesce("_t", F.lit(""))).alias("_t"))
    rows = sorted(rows.select("_k", "_t", "_y").collect())
    return train([r["_t"] for r in rows], [int(r["_y"]) for r in rows])


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, score, predicted."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) if t else 0.0 for t in texts], dtype=float)

    out = docs.select(key, held_out(F.col(key)).alias("held_out"), score(F.col(text)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def offending(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Sentences (key, start, end, probability, sentence) whose own probability is at least `least`."""

    @F.pandas_udf("array<struct<start: long, end: long, probability: double, sentence: string>>")
    def locate(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "probability": p, "sentence": t[a:b]} for a, b, p in model.sentences(t or "") if p >= least] for t in texts])

    return docs.select(key, F.explode(locate(F.col(text))).alias("s")).select(key, "s.*")
