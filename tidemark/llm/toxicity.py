"""Toxic spans and scores: a linear-chain conditional random field over the words of a document.

Every word is tagged toxic or not. Emissions are weights of hashed features (the word, its beginning
and end, the words beside it); transitions and starts have weights of their own. Labels are given for
documents only, so words are labelled first: a word of a toxic document is toxic if it is in clearly more
toxic than clean documents of the sample (the lower bound of its log odds). The field is then trained by
its exact gradient, observed less expected counts from forward-backward, with full-batch Adam.

Forward-backward over a text is exact and works on all texts of a slice as one chain: products of
two-by-two matrices within blocks of 64 words side by side, then one pass over the blocks. Marginals
give offending offsets (runs of words of at least ``SPAN``), and two aggregates of a document, its
largest marginal and its expected number of toxic words, give its score by logistic regression.

Learned from are at most ``DOCUMENTS`` labelled documents of each class outside the held-out fold, and
at most ``PASSAGES`` passages of 64 words of them, both in the order of a hash; everything is scored on whole
texts. A bound on the hash, from a count, comes before each of these choices, so tasks send about as many rows as
are wanted, however many tasks there are.

Rows: null and wordless texts have no words and get the score of none; a doc_id labelled twice counts
with its mean label; unlabelled documents are scored only; without labels of both classes every score is
0.5 without spans; repeated rows get equal scores; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Hasher, mix, raw, slices, words

PASSAGE = 64
DOCUMENTS, PASSAGES = 5_000, 5_000
#: Hashed features: the number of buckets, and features per word.
BUCKETS, KINDS = 1 << 18, 5
HEAD, TAIL = 5, 4
#: A word is labelled where the lower bound of its log odds, so many deviations below, is over this.
EVIDENCE, DEVIATIONS = 1.5, 1.5
ROUNDS, RATE, DECAY = 40, 0.1, 1e-5
SPAN, TOXIC = 0.5, 0.5
FOLDS = 5
LIMIT = 30.0


def word_bytes() -> np.ndarray:
    """Letters, and every byte of other alphabets."""
    inside = np.zeros(256, bool)
    inside[65:91] = inside[97:123] = inside[128:] = True
    return inside


def lowered(flat: np.ndarray) -> np.ndarray:
    return np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)


class Words:
    """Words of a slice with their hashes and feature buckets."""

    def __init__(self) -> None:
        self.hasher, self.inside = Hasher(), word_bytes()

    def load(self, flat: np.ndarray, offs: np.ndarray) -> None:
        flat = lowered(flat)
        self.starts, self.ends, self.first = words(flat, offs, self.inside)
        self.hashes = self.hasher.spans(flat, self.starts, self.ends)
        head = self.hasher.spans(flat, self.starts, np.minimum(self.starts + HEAD, self.ends))
        tail = self.hasher.spans(flat, np.maximum(self.ends - TAIL, self.starts), self.ends)
        before, after = np.zeros_like(self.hashes), np.zeros_like(self.hashes)
        before[1:], after[:-1] = self.hashes[:-1], self.hashes[1:]
        some = self.first[:-1][np.diff(self.first) > 0]
        before[some] = 0
        after[some[1:] - 1] = 0
        kinds = (self.hashes, head, tail, before, after)
        self.buckets = np.stack([(mix(k + np.uint64(i + 1)) % np.uint64(BUCKETS)).astype(np.int32) for i, k in enumerate(kinds)], axis=1)


@dataclass
class Model:
    theta: np.ndarray
    start: float
    move: np.ndarray
    weights: np.ndarray

    def emissions(self, buckets: np.ndarray) -> np.ndarray:
        return np.clip(self.theta[buckets].sum(axis=1), -LIMIT, LIMIT)


def marginals(emission: np.ndarray, first: np.ndarray, start: float, move: np.ndarray) -> np.ndarray:
    """Probability that each word is toxic. ``first``: the first word of each text, one entry more than texts."""
    n = len(emission)
    if not n:
        return np.zeros(0)
    size = PASSAGE
    blocks = -(-n // size)
    odds = np.ones(blocks * size)
    odds[:n] = np.exp(emission)
    fresh = np.zeros(blocks * size, bool)
    fresh[first[:-1][np.diff(first) > 0]] = True
    fresh[n:] = True
    odds, fresh = odds.reshape(blocks, size), fresh.reshape(blocks, size)
    t = np.exp(move)
    s = np.exp(start)

    def step(i: int) -> tuple[np.ndarray, ...]:
        e, f = odds[:, i], fresh[:, i]
        return np.where(f, 1.0, t[0, 0]), np.where(f, s, t[0, 1]) * e, np.where(f, 1.0, t[1, 0]), np.where(f, s, t[1, 1]) * e

    a, b, c, d = step(0)
    for i in range(1, size):
        p, q, r, u = step(i)
        a, b, c, d = a * p + b * r, a * q + b * u, c * p + d * r, c * q + d * u
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    # share of the toxic state before each block, and weight of it behind each block
    left, right = np.zeros(blocks), np.ones(blocks)
    product = np.stack([a, b, c, d], axis=1).tolist()
    x = 0.0
    for k in range(blocks):
        left[k] = x
        p, q, r, u = product[k]
        zero, one = (1 - x) * p + x * r, (1 - x) * q + x * u
        x = one / (zero + one)
    y = 1.0
    for k in range(blocks - 1, -1, -1):
        right[k] = y
        p, q, r, u = product[k]
        y = (r + u * y) / (p + q * y)
        y = min(max(y, 1e-12), 1e12)
    share = np.empty((blocks, size))
    x = left
    for i in range(size):
        p, q, r, u = step(i)
        zero, one = (1 - x) * p + x * r, (1 - x) * q + x * u
        x = one / (zero + one)
        share[:, i] = x
    out = np.empty((blocks, size))
    y = right
    for i in range(size - 1, -1, -1):
        out[:, i] = share[:, i] * y / (1 - share[:, i] + share[:, i] * y)
        p, q, r, u = step(i)
        y = np.clip((r + u * y) / (p + q * y), 1e-12, 1e12)
    return out.reshape(-1)[:n]


def likelihood(emission: np.ndarray, mask: np.ndarray, label: np.ndarray, start: float, move: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Log likelihood of labelled passages (rows), and its gradients by emissions, start and moves."""
    rows, size = emission.shape
    forward = np.zeros((rows, size, 2))
    state = np.stack([np.zeros(rows), start + emission[:, 0]], axis=1)
    forward[:, 0] = state
    for i in range(1, size):
        new = np.logaddexp(state[:, :1] + move[0], state[:, 1:] + move[1])
        new[:, 1] += emission[:, i]
        state = np.where(mask[:, i, None], new, state)
        forward[:, i] = state
    total = np.logaddexp(state[:, 0], state[:, 1])
    back = np.zeros((rows, 2))
    toxic = np.zeros((rows, size))
    moves = np.zeros((2, 2))
    for i in range(size - 1, -1, -1):
        real = mask[:, i]
        toxic[:, i] = np.where(real, np.exp(forward[:, i, 1] + back[:, 1] - total), 0)
        if i:
            here = back + np.stack([np.zeros(rows), emission[:, i]], axis=1)
            for p in range(2):
                for q in range(2):
                    moves[p, q] += np.exp(forward[real, i - 1, p] + move[p, q] + here[real, q] - total[real]).sum()
            before = np.logaddexp(move[:, 0][None] + here[:, :1], move[:, 1][None] + here[:, 1:])
            back = np.where(real[:, None], before, back)
    seen = np.zeros((2, 2))
    pairs = mask[:, 1:]
    for p in range(2):
        for q in range(2):
            seen[p, q] = (pairs & (label[:, :-1] == p) & (label[:, 1:] == q)).sum()
    value = float((emission * label * mask).sum() + start * label[:, 0].sum() + (seen * move).sum() - total.sum())
    return value, np.where(mask, label - toxic, 0), float((label[:, 0] - toxic[:, 0]).sum()), seen - moves


def word_labels(hashes: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words (rows of one passage each in ``doc``) are labelled toxic, by documents that hold them."""
    _, kind = np.unique(hashes, return_inverse=True)
    pairs = np.unique(kind.astype(np.int64) * (int(doc.max()) + 1) + doc)
    of, whose = pairs // (int(doc.max()) + 1), pairs % (int(doc.max()) + 1)
    y = np.zeros(int(doc.max()) + 1, bool)
    y[doc] = toxic
    bad = np.bincount(of[y[whose]], minlength=kind.max() + 1) + 0.5
    good = np.bincount(of[~y[whose]], minlength=kind.max() + 1) + 0.5
    odds = np.log(bad / (y.sum() + 1)) - np.log(good / ((~y).sum() + 1))
    return toxic & ((odds - DEVIATIONS * np.sqrt(1 / bad + 1 / good)) > EVIDENCE)[kind]


def train(buckets: np.ndarray, mask: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of features, start and moves. ``buckets``: passages x words x kinds."""
    used, place = np.unique(buckets, return_inverse=True)
    place = place.reshape(buckets.shape)
    n = len(used)
    w, first, second = (np.zeros(n + 5) for _ in range(3))
    words_ = max(1, int(mask.sum()))
    flat = place.reshape(-1)
    for r in range(1, rounds + 1):
        emission = np.clip(w[place].sum(axis=2), -LIMIT, LIMIT) * mask
        _, at_e, at_s, at_m = likelihood(emission, mask, label, w[n], w[n + 1 :].reshape(2, 2))
        g = np.concatenate([np.bincount(flat, weights=np.repeat(at_e.reshape(-1), place.shape[2]), minlength=n), [at_s], at_m.reshape(-1)]) / words_
        g -= DECAY * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w += RATE * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.999**r)) + 1e-8)
    theta = np.zeros(BUCKETS)
    theta[used] = w[:n]
    return theta, float(w[n]), w[n + 1 :].reshape(2, 2)


def aggregates(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: log odds of its largest marginal, and logarithm of its expected number of toxic words."""
    n = len(first) - 1
    out = np.column_stack([np.full(n, -LIMIT), np.zeros(n)])
    some = np.flatnonzero(np.diff(first))
    if len(some):
        top = np.clip(np.maximum.reduceat(p, first[some]), 1e-13, 1 - 1e-13)
        out[some, 0] = np.log(top) - np.log1p(-top)
        out[some, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.05, p, 0), first[some]))
    return np.column_stack([np.clip(out[:, 0], -10, 10) / 5, out[:, 1], np.ones(n)])


def logistic(x: np.ndarray, y: np.ndarray, toxic: float, decay: float = 0.001) -> np.ndarray:
    """Weights by Newton's method; ``toxic`` is the toxic class's share of all labels, whatever it is of the sample."""
    share = np.where(y > 0.5, toxic / max(y.mean(), 1e-9), (1 - toxic) / max(1 - y.mean(), 1e-9)) / len(y)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -LIMIT, LIMIT)))
        w += np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (share * (y - p)) - decay * w)
    return w


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def _open(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("y"))


def _first(rows: DataFrame, most: int, rank: str, *ties: str) -> DataFrame:
    """Of either class the ``most`` rows of least ``rank``, a number from 0 to 2**63 spread evenly."""
    counted = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = []
    for y in (True, False):
        # half as many again and a hundred more than wanted lie below the bound
        bound = min((1 << 63) - 1, int((1 << 63) * ((1.5 * most + 100) / max(1, counted.get(y, 0)))))
        some.append(rows.filter((F.col("y") == y) & (F.col(rank) <= bound)).orderBy(rank, *ties).limit(most))
    return some[0].unionByName(some[1])


def _sample(docs: DataFrame, labels: DataFrame, documents: int) -> DataFrame:
    some = _first(_open(labels).withColumn("rank", F.shiftrightunsigned(F.xxhash64("doc_id"), 1)), documents, "rank", "doc_id").drop("rank")
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def passages(rows: DataFrame) -> DataFrame:
    """``rank, y, doc, hashes, buckets`` of every passage; ``rank`` is a hash to choose by."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Words()
        for batch in slices(batches):
            found.load(*raw(batch.column("text")))
            ids, y = batch.column("doc_id").to_pylist(), batch.column("y").to_pylist()
            out = []
            for r, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
                for at in range(a, b, PASSAGE):
                    hashes = found.hashes[at : min(at + PASSAGE, b)]
                    rank = int(mix(hashes[:1] + np.uint64(len(hashes)) + np.uint64(at - a))[0] >> np.uint64(1))
                    out.append((rank, y[r], str(ids[r]), hashes.tobytes(), found.buckets[at : at + len(hashes)].tobytes()))
                    if len(out) >= 2000:
                        yield _passages(out)
                        out = []
            if out:
                yield _passages(out)

    return rows.select("doc_id", "text", "y").mapInArrow(scan, "rank long, y boolean, doc string, hashes binary, buckets binary")


def _passages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["rank", "y", "doc", "hashes", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, documents: int = DOCUMENTS, most: int = PASSAGES) -> Model | None:
    """Learn from labelled documents outside the held-out fold."""
    rows = _sample(docs, labels, documents)
    got = _first(passages(rows), most, "rank", "doc", "hashes").collect()
    got.sort(key=lambda r: (r["y"], r["rank"], r["doc"], r["hashes"]))
    if len({r["y"] for r in got}) < 2:
        return None
    length = np.array([len(r["hashes"]) // 8 for r in got])
    mask = np.arange(PASSAGE) < length[:, None]
    hashes = np.frombuffer(b"".join(r["hashes"] for r in got), np.uint64)
    buckets = np.zeros((len(got), PASSAGE, KINDS), np.int32)
    buckets[mask] = np.frombuffer(b"".join(r["buckets"] for r in got), np.int32).reshape(-1, KINDS)
    _, doc = np.unique([r["doc"] for r in got], return_inverse=True)
    y = np.array([r["y"] for r in got])
    label = np.zeros(mask.shape, np.int64)
    label[mask] = word_labels(hashes, np.repeat(doc, length), np.repeat(y, length))
    theta, start, move = train(buckets, mask, label)
    model = Model(theta, start, move, np.zeros(3))
    seen = rows.mapInArrow(_tagger(model, ("doc_id", "y"), ("x",)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y boolean, x array<double>").collect()
    seen.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    toxic = _open(labels).agg(F.avg(F.col("y").cast("int"))).first()[0]
    model.weights = logistic(np.array([r["x"] for r in seen]), np.array([float(r["y"]) for r in seen]), toxic)
    return model


def spans(p: np.ndarray, found: Words, lead: np.ndarray, row: int, start: int) -> str:
    """Runs of toxic words of one text, in code points."""
    a, b = int(found.first[row]), int(found.first[row + 1])
    hit = np.flatnonzero(p[a:b] >= SPAN) + a
    if not len(hit):
        return ""
    cut = np.flatnonzero(np.diff(hit) > 1)
    heads, lasts = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)]
    base = lead[start]
    return ",".join(f"{lead[found.starts[h]] - base}:{lead[found.ends[e]] - base if found.ends[e] < len(lead) else lead[-1] - base}" for h, e in zip(heads, lasts, strict=True))


def _tagger(model: Model | None, kept: tuple[str, ...], made: tuple[str, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Words()
        for batch in slices(batches):
            flat, offs = raw(batch.column("text"))
            columns = {"x": None, "score": pa.array(np.full(batch.num_rows, 0.5)), "spans": pa.array([""] * batch.num_rows)}
            if model is not None:
                found.load(flat, offs)
                p = marginals(model.emissions(found.buckets), found.first, model.start, model.move)
                x = aggregates(p, found.first)
                if "x" in made:
                    columns["x"] = pa.array(list(x), pa.list_(pa.float64()))
                else:
                    columns["score"] = pa.array(1 / (1 + np.exp(-np.clip(x @ model.weights, -LIMIT, LIMIT))))
                    lead = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
                    columns["spans"] = pa.array([spans(p, found, lead, r, int(offs[r])) for r in range(batch.num_rows)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(columns[c] for c in made)], [*kept, *made])

    return scan


def tagged(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score, spans`` of every row; spans are ``start:end`` in code points, comma-joined."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_tagger(model, ("doc_id",), ("score", "spans")), f"doc_id {kind}, score double, spans string")


def op12_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = tagged(docs, fit(docs, labels))
    fold = F.coalesce(held_out(), F.lit(False))
    return found.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "spans")
