"""Quality classifier: gated attention over the passages of a document (multiple-instance learning).

A document is a bag of passages of 64 words. Each is encoded (shares of character classes, word
shape and variety), a small network maps it to a hidden vector, gated attention weighs the vectors
of a document, and a logistic unit scores the weighted sum. Only document labels are learned from;
weights are trained by full-batch Adam on at most ``SAMPLE`` labelled documents (in order of a hash
of doc_id), every document is scored on its whole text.

Rows: null and wordless texts are one empty passage and get a score like others; a doc_id labelled
twice counts with its mean label; unlabelled documents are scored only; without labels every score
is 0.5; repeated rows get equal scores; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Hasher, raw, slices, word_table, words

PASSAGE = 64
#: At most so many labelled documents are learned from.
SAMPLE = 6_000
HIDDEN, GATE, ROUNDS, RATE, SEED = 16, 8, 250, 0.02, 5
FOLDS, KEEP = 5, 0.3
#: Character classes that passages are described by.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b".", b",;:", b"'\"()-", b"#$%&*@^~=+", b"|<>[]{}\\/_", b"\n")
WIDE = len(CLASSES) + 2
FEATURES = WIDE + 5


def encode(flat: np.ndarray, offs: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many passages each text has (one at least)."""
    kind = np.full(256, len(CLASSES), np.int64)
    kind[128:] = len(CLASSES) + 1
    for i, chars in enumerate(CLASSES):
        kind[list(chars)] = i
    starts, ends, first = words(flat, offs, word_table())
    n = np.diff(first)
    count = np.maximum(1, -(-n // PASSAGE))
    total = int(count.sum())
    base = np.cumsum(count) - count
    passage_of_word = np.repeat(base, n) + (np.arange(len(starts)) - np.repeat(first[:-1], n)) // PASSAGE
    # a passage reaches from its first word to the next passage's first word
    new = np.ones(len(starts), bool)
    new[1:] = passage_of_word[1:] != passage_of_word[:-1]
    head, owner = starts[new], passage_of_word[new]
    row = np.searchsorted(base, owner, side="right") - 1
    until = np.append(head[1:], len(flat))
    until = np.minimum(until, offs[1:][row])
    size = until - head
    place = np.repeat(owner, size)
    byte = np.repeat(head - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    shares = np.bincount(place * WIDE + kind[flat[byte]], minlength=total * WIDE).reshape(total, WIDE).astype(np.float64)
    length = np.maximum(np.bincount(place, minlength=total), 1)
    n_words = np.bincount(passage_of_word, minlength=total)
    spans = ends - starts
    letters = np.bincount(passage_of_word, weights=spans, minlength=total)
    if len(starts):
        upper = np.add.reduceat((kind[flat] == 0).astype(np.int64), starts) if len(flat) else 0
        loud = np.bincount(passage_of_word, weights=(upper > 1), minlength=total)
        h = hasher.spans(flat, starts, ends)
        mixed = np.unique((passage_of_word.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
        distinct = np.bincount((mixed >> np.uint64(36)).astype(np.int64), minlength=total)
    else:
        loud = distinct = np.zeros(total)
    some = np.maximum(n_words, 1)
    shape = np.column_stack([letters / some / 10, loud / some, distinct / some, np.log1p(n_words) / 5, (shares[:, 7] + shares[:, 8]) / some])
    return np.column_stack([shares / length[:, None], shape]).astype(np.float32), count


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return forward(self.weights, (x - self.mean) / self.scale, count)["p"]


def _sums(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, heads, axis=0)


def forward(w: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    heads, doc = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, heads)[doc])
    att = e / _sums(e, heads)[doc]
    z = _sums(att[:, None] * h, heads)
    logit = z @ w["c"] + w["d"]
    return {"h": h, "t": t, "g": g, "att": att, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    heads, doc = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
    f = forward(w, x, count)
    error = (f["p"] - y) / len(y)
    h, att = f["h"], f["att"]
    at_z = error[:, None] * w["c"]
    along = (h * at_z[doc]).sum(axis=1)
    at_e = att * (along - _sums(att * along, heads)[doc])
    gated = at_e[:, None] * w["a"]
    at_t, at_g = gated * f["g"] * (1 - f["t"] ** 2), gated * f["t"] * f["g"] * (1 - f["g"])
    at_h = (att[:, None] * at_z[doc] + at_t @ w["V"].T + at_g @ w["U"].T) * (1 - h**2)
    return {"W": x.T @ at_h, "b": at_h.sum(axis=0), "V": h.T @ at_t, "U": h.T @ at_g, "a": (f["t"] * f["g"]).T @ at_e, "c": f["z"].T @ error, "d": error.sum(keepdims=True)}


def train(x: np.ndarray, count: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(SEED)
    shapes = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    w = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for r in range(1, rounds + 1):
        for k, g in gradients(w, x, count, y).items():
            g = g + 1e-4 * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**r)) / (np.sqrt(second[k] / (1 - 0.999**r)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from labelled documents outside the held-out fold; at most ``sample`` doc_ids."""
    open_ = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    chosen = open_.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches):
        hasher = Hasher()
        for batch in slices(batches):
            x, count = encode(*raw(batch.column("text")), hasher)
            parts = [p.tobytes() for p in np.split(x, np.cumsum(count)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(parts, pa.binary())], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "text", "y").mapInArrow(features, f"doc_id {kind}, y double, x binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["doc_id"], zlib.crc32(r["x"])))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in found]
    return train(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([r["y"] for r in found], np.float32))


def _scores(batch: pa.RecordBatch, model: Model | None, hasher: Hasher) -> np.ndarray:
    if model is None:
        return np.full(batch.num_rows, 0.5)
    return model.score(*encode(*raw(batch.column("text")), hasher)).astype(np.float64)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every row."""

    def run(batches):
        hasher = Hasher()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch, model, hasher))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The documents that score at least ``least``, in their own columns."""
    model = fit(docs, labels)

    def run(batches):
        hasher = Hasher()
        for batch in slices(batches):
            yield batch.filter(pa.array(_scores(batch, model, hasher) >= least))

    return docs.mapInArrow(run, docs.schema)


def op6_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs, fit(docs, labels))
    fold = F.coalesce(held_out(), F.lit(False))
    return found.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
