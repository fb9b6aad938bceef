"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, prepare_python, raw, remembered, saved, sent_if_small, thrifty, words

#: Features are hashed to 2 ** BITS coordinates.
BITS = 22
#: Most labelled documents that are learned from: those with the least hash of their id.
SAMPLE = 10_000
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 15.0, 0.1, 8
#: Rejected documents whose ids are sent to all executors; more are taken out by a shuffle.
BROADCAST_REJECTED = 1_000_000


@dataclass
class Model:
    """Sparse weights: coordinates in order, their weights, and the intercept. L1 leaves few that are not 0."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(tokens: list[bytes], bits: int = BITS) -> np.ndarray:
    """Hashed coordinates of words, pairs of neighbours and pairs with one word between, in the text's order."""
    h = np.fromiter(map(zlib.crc32, tokens), dtype=np.uint64, count=len(tokens))
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    shift = np.uint64(64 - bits)
    pair = lambda a, b, k: ((a * np.uint64(k) + b) * np.uint64(0xD6E8FEB86659FD93)) >> shift
    return np.concatenate((
        (h * np.uint64(0xD6E8FEB86659FD93)) >> shift,
        pair(h[:-1], h[1:], 0xA0761D6478BD642F),
        pair(h[:-2], h[2:], 0xE7037ED1A0B428DB),
    ))


def fit(samples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, passes: int = PASSES) -> Model:
    """FTRL-proximal with a rate for each coordinate. A sample is its distinct coordinates; the intercept is not regularised.

    A gradient is 1 at most, so a coordinate that a single document has can't pass `l1` in as many passes or fewer: then
    those are left out before.
    """
    # what is left is numbered anew, so that state is as large as that
    once, shared = np.zeros(2**bits, dtype=bool), np.zeros(2**bits, dtype=bool)
    for x in samples:
        shared[x] |= once[x]
        once[x] = True
    kept = shared if passes <= l1 else once
    known = np.flatnonzero(kept)
    samples = [np.searchsorted(known, x[kept[x]]).astype("<u4") for x in samples]
    z, n = np.zeros(len(known)), np.zeros(len(known))
    zb = nb = 0.0
    positive = max(1, int(labels.sum()))
    order = np.random.default_rng(0).permutation(len(labels))
    # a prior of the classes to start from, as if it had been learned
    bias0 = float(np.log(positive / max(1, len(labels) - positive))) if len(labels) else 0.0
    bias = bias0
    for _ in range(passes):
        for i in order:
            x = samples[i]
            zx, nx = z[x], n[x]
            rate = (beta + np.sqrt(nx)) / alpha + l2
            w = np.where(np.abs(zx) > l1, (np.sign(zx) * l1 - zx) / rate, 0.0)
            bias = bias0 - zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - labels[i]
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
            sb = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            zb += g - sb * (bias - bias0)
            nb += g * g
    live = np.flatnonzero(np.abs(z) > l1)
    weight = (np.sign(z[live]) * l1 - z[live]) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return Model(known[live].astype(np.int64), weight, bias)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on at most `sample` labelled documents, whole texts of them, those with the least hash of their id.

    Executors turn texts into distinct coordinates; one task gets those (bounded by `sample` times 2 ** bits, some
    kilobytes each for usual texts) and fits, the driver gets the model only. `learn` is a condition on the id. Ids without a label, with a null label
    or without a document are left out; of rows that share an id the label is the largest. Without any label all
    scores are 0.5.
    """
    prepare_python(docs.sparkSession)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        chosen = chosen.where(learn)
    chosen = chosen.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("raw")).join(F.broadcast(chosen), "doc_id")

    def coordinates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            own = [np.unique(features(words(t), bits)).astype("<u4").tobytes() for t in frame["raw"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "x": own})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((r for frame in batches for r in zip(frame["doc_id"], frame["x"], frame["label"], strict=True)), key=lambda r: r[:2])
        model = fit([np.frombuffer(x, dtype="<u4") for _, x, _ in rows], np.asarray([label for *_, label in rows], dtype=float), bits)
        yield pd.DataFrame({"index": [model.index.astype("<i8").tobytes()], "weight": [model.weight.astype("<f8").tobytes()], "bias": [model.bias]})

    samples = texts.mapInPandas(thrifty(coordinates), "doc_id long, label int, x binary").repartition(1)
    row = samples.mapInPandas(thrifty(fitted), "index binary, weight binary, bias double").first()
    if row is None:  # a plan without rows has no task
        return fit([], np.zeros(0), bits)
    return Model(np.frombuffer(row["index"], dtype="<i8"), np.frombuffer(row["weight"], dtype="<f8"), row["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, score) of whole texts, 0 to 1; null and empty texts have the score of the intercept. No shuffle."""
    spark = docs.sparkSession
    prepare_python(spark)
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = remembered("toxicity", key, lambda: Scorer(sent.value, bits))
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": [scorer(t) for t in frame["raw"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("raw")).mapInPandas(thrifty(run), "doc_id long, score double")


class Scorer:
    """Scores texts with a model; few coordinates have a weight, so a table of bits finds those of a text."""

    def __init__(self, model: Model, bits: int = BITS):
        self.model, self.bits = model, bits
        self.live = np.zeros(2**bits, dtype=bool)
        self.live[model.index] = True

    def __call__(self, text: bytes) -> float:
        x = features(words(text), self.bits)
        x = np.unique(x[self.live[x]]).astype(np.int64)
        total = self.model.bias + self.model.weight[np.searchsorted(self.model.index, x)].sum()
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns.

    Only ids and hashes of the rejected rows come from Python, and are written; rows with the same id and text go by them,
    so the other columns, of any name, never pass through Python. Rows that share an id are scored each on its own; null
    and empty texts have the score of the intercept, null ids are ids like others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    own_id, own_hash = fresh("id"), fresh("hash")
    row_id, row_hash = F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = remembered("toxicity", key, lambda: Scorer(sent.value, bits))
        for frame in batches:
            bad = np.fromiter((scorer(t) >= threshold for t in frame["raw"]), dtype=bool, count=len(frame))
            yield frame.loc[bad, [own_id, own_hash]].astype({own_id: "Int64"})

    scored = docs.select(row_id.alias(own_id), row_hash.alias(own_hash), raw(text_col).alias("raw"))
    rejected = saved(scored.mapInPandas(thrifty(run), f"{own_id} long, {own_hash} long").distinct(), "toxic")
    return docs.join(sent_if_small(rejected, BROADCAST_REJECTED), row_id.eqNullSafe(F.col(own_id)) & (row_hash == F.col(own_hash)), "left_anti")
