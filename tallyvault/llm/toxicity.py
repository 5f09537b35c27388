"""Toxicity scores of whole texts.

Method: a factorization machine over hashed terms.  The terms of a text are its
distinct words and their beginnings of `PREFIXES` characters, hashed.  Besides a
weight, each term has a vector of `FACTORS` numbers, and the product of two terms'
vectors is the weight of the pair, so that a pair (an insult beside the mention of a
group) can count for more than the sum of its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.llm.common import settle

#: Bounds of the labelled sample that is fitted: rows of each label, and the hashed terms with the clearest difference between labels.
SAMPLE = 6_000
FEATURES = 1_024
FACTORS = 4
EPOCHS = 150
BITS = 24
PREFIXES = (4, 5, 6)
LEAST_ROWS = 2
_WORD = re.compile(r"\w+")


def terms(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words | {f"{w[:n]}*" for n in PREFIXES for w in words if len(w) > n}


def hashed(term: str) -> int:
    return xxhash.xxh32_intdigest(term) & ((1 << BITS) - 1)


class Machine:
    """w0 + sum w_i x_i + sum <v_i, v_j> x_i x_j over presence of the kept hashed terms."""

    def __init__(self, kept: list[int], rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS):
        """Fit on `rows`, each the kept terms that a text has, with labels of 0 and 1 and a weight each."""
        self.index = {t: i for i, t in enumerate(kept)}
        y = labels.astype(np.float64)
        rate = float(np.average(y, weights=weights)) if len(y) else 0.0
        self.bias = float(np.log((rate + 1e-4) / (1 - rate + 1e-4)))
        self.w, self.v = np.zeros(len(kept)), np.zeros((len(kept), factors))
        if kept and 0 < y.sum() < len(y):
            x = np.zeros((len(y), len(kept)), np.float32)
            for i, row in enumerate(rows):
                x[i, [self.index[t] for t in row]] = 1
            self._fit(x, y, weights / weights.mean(), factors, epochs)

    def _fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, factors: int, epochs: int) -> None:
        """Adam on the whole sample; the weights shrink towards nothing."""
        dice = np.random.default_rng(7)
        f = x.shape[1]
        params = [np.zeros(1), np.zeros(f), dice.normal(0, 0.05, (f, factors))]
        params[0][0] = self.bias
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for t in range(1, epochs + 1):
            w0, w, v = params
            xv = x @ v.astype(np.float32)
            raw = w0[0] + x @ w.astype(np.float32) + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1).astype(np.float32))
            err = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) * weight / len(y)).astype(np.float32)
            ex = x.T @ err
            grads = [np.array([err.sum()]), ex + 1e-5 * w, x.T @ (err[:, None] * xv) - v * ex[:, None] + 1e-4 * v]
            for p, g, (m, s) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.bias, self.w, self.v = float(params[0][0]), params[1], params[2]

    def score(self, present: list[list[int]]) -> np.ndarray:
        """Probabilities of texts, given as the kept terms that each has."""
        n = len(present)
        owner = np.repeat(np.arange(n), [len(p) for p in present])
        flat = np.fromiter((i for p in present for i in p), np.int64, len(owner))
        raw = self.bias + np.bincount(owner, self.w[flat], n)
        for k in range(self.v.shape[1]):
            v = self.v[flat, k]
            raw += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Machine:
    """Fit on at most about `sample` rows of each label, spread over all labelled rows by a hash of the id.

    `labels` has doc_id and toxic; a null is no label, and a document that is labelled
    more than once is toxic if any label says so.  With one label only, or none, every
    text gets the smoothed rate of the labels.  Of different texts of one labelled id the one
    with the least hash is fitted, so the model hangs on the rows alone, not on their order.  What the sample holds of each label is
    weighted back to that label's share of all rows.  The terms are chosen on the executors;
    only the kept ones, `features` at most a row, come to the driver.  They are the terms
    whose own counts differ most between the labels: a pair of which neither half differs by
    itself is learned only if both are among them.  Terms chosen otherwise did worse on
    held-out labels (README).
    """
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in clean.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample / counts.get(1, 1))).otherwise(min(1.0, sample / counts.get(0, 1)))
    picked = clean.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)

    def hash_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "h": batch["h"], "terms": [sorted({hashed(t) for t in terms(x)}) for x in batch["text"]]})

    # the sample is at most about 2 x `sample` ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    each_text = texts.join(F.broadcast(picked), "doc_id").mapInPandas(hash_terms, "doc_id long, toxic int, h long, terms array<int>")
    rows = settle(each_text.groupBy("doc_id").agg(F.min(F.struct("h", "toxic", "terms")).alias("r")).select("doc_id", "r.toxic", "r.terms"))
    each = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    mean = each.get(1, 0) / max(1, sum(each.values()))
    n, ones = F.col("n"), F.col("ones")
    clear = F.abs(ones - n * mean) / F.sqrt(n * mean * (1 - mean) + 1)
    counted = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("ones"))
    best = counted.filter(n >= LEAST_ROWS).withColumn("clear", clear).filter("clear > 0").orderBy(F.desc("clear"), "term").limit(features)
    kept = [r["term"] for r in best.select("term").collect()]
    had = F.array_intersect("terms", F.array(*[F.lit(t) for t in kept]).cast("array<int>"))
    got = rows.select("doc_id", "toxic", had.alias("terms")).orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in got], np.int64)
    return Machine(kept, [r["terms"] for r in got], y, np.array([counts[int(t)] / each[t] for t in y], np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of each row of `docs`; no shuffle.

    Null and empty texts have no terms and get the score of the bias.  Repeated rows and
    null ids come out as they are; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known: dict[str, int] = {}  # of words met lately: the kept term, or -1
        for batch in batches:
            present = []
            for text in batch["text"]:
                own = set()
                for t in terms(text if isinstance(text, str) else None):
                    i = known.get(t)
                    if i is None:
                        i = known[t] = m.index.get(hashed(t), -1)
                    if i >= 0:
                        own.add(i)
                present.append(sorted(own))
                if len(known) > 500_000:
                    known.clear()
            s = m.score(present)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": s, "predicted": (s >= 0.5).astype("int32")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, score double, predicted int")
