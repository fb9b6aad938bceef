"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare_python, raw, thrifty

#: Subwords are hashed to 2 ** BITS embeddings of WIDTH numbers.
BITS, WIDTH = 16, 16
#: Most labelled documents that are learned from; a fifth of them are for calibration only.
SAMPLE = 1_500
PASSES, RATE, BATCH = 10, 4.0, 16
#: Predictions with a lower calibrated score are marked as rejected.
REJECT = 0.5
BLOCK = 1 << 20

_LETTERS = bytes.maketrans(bytes(range(65, 91)) + bytes([c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122)]), bytes(range(97, 123)) + b" " * 76)


@dataclass
class Model:
    languages: list[str]
    #: Embeddings times the softmax's weights: what a subword adds to each language.
    table: np.ndarray
    bias: np.ndarray
    #: The scale of the logits that fits the calibration documents best.
    scale: float


def subwords(text: bytes, bits: int = BITS) -> np.ndarray:
    """Hashes of all runs of 2 to 4 bytes of the text, A-Z lower-cased, other ASCII than letters as one space each."""
    return np.concatenate([np.zeros(0, dtype=np.uint32), *_blocks(text, bits)])


def _blocks(text: bytes, bits: int = BITS, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The same, for a block of a long text at a time. A run that crosses an edge belongs to the block that it starts in."""
    text = b" " + text.translate(_LETTERS) + b" "
    for at in range(0, len(text), block):
        b = np.frombuffer(text[at : at + block + 3], dtype=np.uint8).astype(np.uint32)
        h = b
        for n in range(2, 5):
            if len(b) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
            yield ((h * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits))[:block]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], bits: int = BITS, width: int = WIDTH, passes: int = PASSES) -> Model:
    """Stochastic gradient descent on the softmax's loss over batches of documents; then the scale by a line search.

    A sample has the coordinates of its subwords and their shares of the document.
    """
    rng = np.random.default_rng(0)
    k = len(languages)
    emb, out, bias = rng.normal(0, 0.1, (2**bits, width)), rng.normal(0, 0.1, (width, k)), np.zeros(k)
    order = rng.permutation(len(samples))
    held = len(order) // 5 if len(order) >= 50 else 0
    fitted, calibration = order[held:], order[:held] if held else order

    def mean(i: int) -> np.ndarray:
        x, share = samples[i]
        return share @ emb[x]

    for turn in range(passes):
        rate = RATE * (1 - turn / passes)
        for at in range(0, len(fitted), BATCH):
            own = fitted[at : at + BATCH]
            hidden = np.stack([mean(i) for i in own])
            error = _softmax(hidden @ out + bias)
            error[np.arange(len(own)), labels[own]] -= 1
            error /= len(own)
            back = error @ out.T
            for row, i in enumerate(own):
                x, share = samples[i]
                emb[x] -= rate * len(own) * share[:, None] * back[row]
            out -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
        rng.shuffle(fitted)
    scale = 1.0
    if len(calibration):
        logits = np.stack([mean(i) for i in calibration]) @ out + bias
        loss = lambda s: -np.log(_softmax(logits * s)[np.arange(len(calibration)), labels[calibration]] + 1e-12).mean()
        scale = float(min(np.geomspace(0.1, 30, 60), key=loss))
    return Model(languages, (emb @ out).astype(np.float32), bias, scale)


def train(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on at most `sample` documents with a text and a label, whole texts of them, those with the least hash of their id.

    Executors turn texts into shares of hashed subwords (at most 2 ** bits of them a document, whatever its length); the
    driver gets those and fits. Without any such document the model knows no language and all is `und`.
    """
    prepare_python(docs.sparkSession)
    usable = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        usable = usable.where(learn)
    ids = usable.select(F.col(id_col).cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = usable.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("string").alias("label"), raw(text_col).alias("raw")).join(F.broadcast(ids), "doc_id")

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            x, n = [], []
            for text in frame["raw"]:
                counts = np.bincount(subwords(text, bits), minlength=1)
                own = np.flatnonzero(counts)
                x.append(own.astype("<u4").tobytes())
                n.append((counts[own] / max(1, counts.sum())).astype("<f4").tobytes())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "x": x, "share": n})

    rows = texts.mapInPandas(thrifty(shares), "doc_id long, label string, x binary, share binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.x))
    languages = sorted({r.label for r in rows})
    samples = [(np.frombuffer(r.x, dtype="<u4").astype(np.int64), np.frombuffer(r.share, dtype="<f4").astype(float)) for r in rows]
    if not rows:
        return Model([], np.zeros((2**bits, 0), dtype=np.float32), np.zeros(0), 1.0)
    return fit(samples, np.asarray([languages.index(r.label) for r in rows]), languages, bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT, bits: int = BITS) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of whole texts; `und` with score 0 if a text is null or has no letter. No shuffle.

    The score is the calibrated probability of the predicted language. A long text is read in blocks of bounded size.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for frame in batches:
            names, scores = [], []
            for text, letters in zip(frame["raw"], frame["letters"], strict=True):
                if not letters or not m.languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                total, n = np.zeros(len(m.languages)), 0
                for x in _blocks(text, bits):
                    # every subword of the block adds its row of the table
                    total += np.bincount(x, minlength=2**bits) @ m.table if len(x) > 2 ** (bits - 1) else m.table[x].sum(axis=0, dtype=float)
                    n += len(x)
                p = _softmax((total[None, :] / max(1, n) + m.bias) * m.scale)[0]
                names.append(m.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "lang_pred": names, "score": scores, "rejected": np.asarray(scores) < reject})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("raw"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInPandas(thrifty(run), "doc_id long, lang_pred string, score double, rejected boolean")
