"""Document fingerprints by MinHash.

Each of 128 hash functions h(x) = a*x + b modulo 2**64 (a odd, a permutation of the 64-bit numbers)
is run over all shingle hashes of a slice of texts at once; the minimum per document is one slot of
its fingerprint, of which 16 bits are kept. Likeness is the share of equal slots. Near duplicates
are found by joining bands of slots in Spark and checking the Jaccard similarity of the candidates.

Rows: a null text is empty; texts under five words are one shingle, wordless ones have none (all
slots at their largest; alike among themselves, likeness 1, and unlike any text with words,
likeness 0); the next document follows in (doc_id, text hash) order, null doc_ids last; a single
document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LAST_ID, Hasher, keyed, lanes, mix, raw, slices, word_table, words

SLOTS, WIDTH, BANDS, ROWS = 128, 5, 25, 5
SIMILAR = 0.8
NONE = np.uint16(0xFFFF)


def permutations(slots: int = SLOTS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        a = mix(np.arange(1, slots + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
        return a, mix(a)


def shingles(flat: np.ndarray, offs: np.ndarray, hasher: Hasher, inside: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in order, and how many each row has."""
    starts, ends, first = words(flat, offs, inside)
    w = hasher.spans(flat, starts, ends)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    row_end = np.repeat(first[1:], count)
    x = np.zeros(len(at), np.uint64)
    for k in range(width):
        there = at + k < row_end
        x = mix(x * np.uint64(31) + np.where(there, w[np.minimum(at + k, max(len(w) - 1, 0))], np.uint64(k + 1))) if len(w) else x
    return x, count


def signatures(x: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row of 16-bit slots per document."""
    out = np.full((len(count), len(a)), NONE, np.uint16)
    some = np.flatnonzero(count)
    if len(some):
        heads = (np.cumsum(count) - count)[some]
        for k in range(len(a)):
            least = np.minimum.reduceat(x * a[k] + b[k], heads)
            # the high bits of a minimum are near zero: keep a hash of the whole value
            out[some, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(s: np.ndarray, t: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Share of equal slots; ``none`` marks pairs of which exactly one text has no words."""
    return np.where(none, 0.0, (s == t).mean(axis=1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``id, th, fingerprint`` (slots in hex) and ``bands`` (array of longs) of every row."""

    def sign(batches):
        hasher, inside, (a, b) = Hasher(), word_table(), permutations()
        for batch in slices(batches):
            flat, offs = raw(batch.column("text"))
            x, count = shingles(flat, offs, hasher, inside)
            s = signatures(x, count, a, b)
            bands = np.zeros((len(s), BANDS), np.uint64)
            for k in range(ROWS):
                bands = mix(bands * np.uint64(31) + s[:, k : BANDS * ROWS : ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(1 << 20))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
            prints = pa.array([r.tobytes().hex() for r in s.astype(">u2")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), prints, listed], ["id", "th", "fingerprint", "bands"])

    return keyed(docs).select("id", "th", "text").mapInArrow(sign, "id long, th long, fingerprint string, bands array<long>")


def near_pairs(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs ``th_a < th_b`` of different texts with a Jaccard similarity of at least ``similar``, and ``jaccard``.

    Equal texts are one text here: join ``th`` back to the rows for their members.
    """
    texts = keyed(docs).dropDuplicates(["th"])
    banded = fingerprints(texts.select("doc_id", "text")).select("th", F.posexplode("bands").alias("band", "key"))
    left, right = banded.withColumnRenamed("th", "th_a"), banded.withColumnRenamed("th", "th_b")
    pairs = left.join(right, ["band", "key"]).filter("th_a < th_b").select("th_a", "th_b").distinct()

    def sets(batches):
        hasher, inside = Hasher(), word_table()
        for batch in slices(batches):
            flat, offs = raw(batch.column("text"))
            x, count = shingles(flat, offs, hasher, inside)
            parts = [np.unique(p).view(np.int64) for p in np.split(x, np.cumsum(count)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array(parts, pa.list_(pa.int64()))], ["th", "grams"])

    grams = texts.select("th", "text").mapInArrow(sets, "th long, grams array<long>")
    both = pairs.join(grams.withColumnsRenamed({"th": "th_a", "grams": "a"}), "th_a").join(grams.withColumnsRenamed({"th": "th_b", "grams": "b"}), "th_b")
    shared = F.size(F.array_intersect("a", "b"))
    either = F.size("a") + F.size("b") - shared
    jaccard = F.when(either > 0, shared / either).otherwise(F.lit(1.0))
    return both.select("th_a", "th_b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= similar)


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of doc_id, each range followed by a copy of the next one's first rows.

    ``part`` is the range, ``copy`` marks the copies; sorted, every row stands before its successor.
    Texts are shuffled once. The range bounds and first ids are one number per range.
    """
    spark = docs.sparkSession
    ids = keyed(docs).select("id")
    n = 4 * lanes(spark)
    bounds = sorted(set(ids.approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    bounds = sorted({min(int(b), LAST_ID) for b in bounds})
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    firsts = sorted((r["part"], r["first"]) for r in ids.groupBy(part.alias("part")).agg(F.min("id").alias("first")).collect())
    rows = keyed(docs).withColumn("part", part)
    if not firsts:
        return rows.withColumn("copy", F.lit(False))
    heads = F.create_map(*(F.lit(x) for i, (_, first) in enumerate(firsts) for x in (first, firsts[i - 1][0])))
    own = F.struct(F.col("part"), F.lit(False).alias("copy"))
    also = F.struct(F.element_at(heads, F.col("id")).alias("part"), F.lit(True).alias("copy"))
    dealt = rows.withColumn("to", F.explode(F.when(F.map_contains_key(heads, F.col("id")), F.array(own, also)).otherwise(F.array(own))))
    return dealt.select("doc_id", "text", "id", "th", "to.part", "to.copy").repartition(lanes(spark), "part").sortWithinPartitions("part", "copy", "id", "th")


def _compare(batches):
    """Each row against its edited text and its successor; rows as ``beside_next`` deals them."""
    hasher, inside, (a, b) = Hasher(), word_table(), permutations()
    held: pa.Table | None = None

    def sign(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, offs = raw(pa.array(texts, pa.large_binary()))
        x, count = shingles(flat, offs, hasher, inside)
        return signatures(x, count, a, b), count

    def work(rows: pa.Table):
        part, copy = rows["part"].to_numpy(), rows["copy"].to_numpy(zero_copy_only=False)
        texts = [t or "" for t in rows["text"].to_pylist()]
        own = np.flatnonzero(~copy[:-1] & (part[:-1] == part[1:]))
        if not len(own):
            return
        edited = []
        for i in own:
            t = texts[i]
            cut = len(t) // 4
            edited.append((t[: len(t) - cut] + texts[i + 1][:cut]).encode())
        s, some = sign([t.encode() for t in texts])
        e, some_e = sign(edited)
        columns = [
            rows["doc_id"].take(pa.array(own)).combine_chunks(),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
            pa.array([r.tobytes().hex() for r in s[own].astype(">u2")], pa.string()),
            pa.array([r.tobytes().hex() for r in e.astype(">u2")], pa.string()),
            pa.array(likeness(s[own], e, (some[own] > 0) != (some_e > 0))),
            pa.array(likeness(s[own], s[own + 1], (some[own] > 0) != (some[own + 1] > 0))),
        ]
        yield from pa.Table.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).combine_chunks().to_batches()

    for batch in slices(batches):
        now = pa.Table.from_batches([batch])
        rows = now if held is None else pa.concat_tables([held, now])
        yield from work(rows)
        held = rows.slice(rows.num_rows - 1)


def op3_query(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return beside_next(docs).mapInArrow(_compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
