"""Long repeated windows of units (words or bytes) across a corpus: the steps both removals share.

1. Every window of W units has an anchor: the least hash among its k-grams. Equal windows have equal
   anchors, so a window whose anchor occurs once is unique. One scan writes the anchors of each
   document (about two in W - k + 2 units, a sparse sample of all suffixes).
2. Anchors that occur again are found by a map-side combined count, and go back to their documents.
3. A second scan, of those documents only, cuts fragments: runs of consecutive windows with one
   repeated anchor, with all their units. Equal fragments of a task are sent once, with the smallest
   document and a count; where each lies is written beside, without content. Where longer strings are
   asked for beside the windows, a fragment goes on to the end of its last one: equal strings start
   with equal windows, so they meet by the same anchor.
4. Fragments meet by anchor. The method's own index (suffix tree, suffix array) is built over a
   bounded bucket of them at a time and says which windows repeat.
5. The verdicts go back to where the fragments lie, are gathered per document and applied.

An anchor with very many occurrences (a common line) is set back: windows choose another anchor
where they can, and windows made of common grams only are equal fragments that merge.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MIX_1, Hasher, keyed, lanes, mix, raw, slices, stored, word_table, words

TOP = np.uint64((1 << 64) - 1)
#: An anchor with more occurrences than this (or a ten-thousandth of all, if more) is set back.
COMMON = 10_000
#: Content that a task gathers before it sends its fragments, and that a bucket holds at least.
TASK_BYTES, BUCKET_BYTES = 32 << 20, 1 << 20
#: Bytes of one document that are windowed at once.
PIECE = 1 << 20


@dataclass(frozen=True)
class Kind:
    """What a window is made of. ``units``: "byte" or "word"; ``documents``: occurrences count by document.

    ``reach``: length of the strings whose repeats are marked, ``window`` or more.
    """

    units: str
    window: int
    gram: int
    documents: bool
    reach: int


class Units:
    """The units of a slice of documents, as hashes or byte values, with row offsets and contents."""

    def __init__(self, kind: Kind, hasher: Hasher, inside: np.ndarray) -> None:
        self.kind, self.hasher, self.inside = kind, hasher, inside

    def load(self, column: pa.Array) -> None:
        self.flat, self.offs = raw(column)
        if self.kind.units == "byte":
            self.values, self.first = self.flat, self.offs
        else:
            self.starts, self.ends, self.first = words(self.flat, self.offs, self.inside)
            self.values = self.hasher.spans(self.flat, self.starts, self.ends)

    def content(self, start: int, end: int) -> bytes:
        """Units ``start`` to ``end``; words joined by one space."""
        if self.kind.units == "byte":
            return self.flat[start:end].tobytes()
        return b" ".join(self.flat[self.starts[start] : self.ends[end - 1]].tobytes().split())


def sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values, by doubling."""
    n, span, out = len(values), 1, values
    while span * 2 <= width:
        out = best(out[: len(out) - span], out[span:])
        span *= 2
    return best(out[: n - width + 1], out[width - span : width - span + n - width + 1]) if width > span else out[: n - width + 1]


def anchors(values: np.ndarray, first: np.ndarray, kind: Kind, hasher: Hasher, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and per window start its anchor (TOP where no window of one row starts)."""
    grams = hasher.grams(values, kind.gram)
    np.minimum(grams, TOP - np.uint64(1), out=grams)
    n = len(values) - kind.window + 1
    if n <= 0:
        return grams, np.full(0, TOP)
    order = grams >> np.uint64(1)
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        order = np.where(common[at] == grams, order | np.uint64(1 << 63), order)
    least = sliding(order, kind.window - kind.gram + 1, np.minimum)
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    return grams, np.where(np.arange(n) + kind.window <= row_end, least, TOP)


def _runs(least: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of windows of one row with one anchor."""
    n = len(least)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    new[first[:-1][first[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    real = least[starts] != TOP
    return starts[real], ends[real]


def pieces(first: np.ndarray, kind: Kind) -> list[tuple[int, int]]:
    """Unit ranges worked on at once: whole rows together up to PIECE units, a longer row cut with overlap."""
    out, at, rows = [], 0, len(first) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(first, first[at] + PIECE, side="right")) - 1)
        lo, hi = int(first[at]), int(first[end])
        while hi - lo > PIECE + kind.window:
            out.append((lo, lo + PIECE + kind.window - 1))
            lo += PIECE
        if hi > lo:
            out.append((lo, hi))
        at = end
    return out


def _within(first: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that meet units lo..hi, and their bounds from lo on."""
    a = int(np.searchsorted(first, lo, side="right")) - 1
    b = int(np.searchsorted(first, hi, side="left"))
    return np.arange(a, b), np.clip(first[a : b + 1], lo, hi) - lo


def seeds(kind: Kind, summary: Callable) -> Callable:
    """First scan. A row per document (``h`` null) with its length and digest, and one per anchor in it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, units = Hasher(), Units(kind, Hasher(), word_table())
        for batch in slices(batches):
            units.load(batch.column("text"))
            ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            found = []
            for lo, hi in pieces(units.first, kind):
                rows, first = _within(units.first, lo, hi)
                values = units.values[lo:hi]
                grams, least = anchors(values, first, kind, hasher)
                starts, _ = _runs(least, first)
                if not len(starts):
                    continue
                if kind.documents:
                    at, h = starts, least[starts]
                else:
                    # every gram that is the least of some window over it: ties count as occurrences
                    width = kind.window - kind.gram + 1
                    open_ = np.concatenate([np.zeros(width - 1, np.uint64), np.where(least == TOP, np.uint64(0), least), np.zeros(width - 1, np.uint64)])
                    at = np.flatnonzero((grams >> np.uint64(1)) == sliding(open_, width, np.maximum)[: len(grams)])
                    h = grams[at] >> np.uint64(1)
                row = rows[np.searchsorted(first, at, side="right") - 1]
                found.append(np.stack([row.astype(np.uint64), h]))
            n_rows = batch.num_rows
            n, digest = summary(units)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("id"), batch.column("th"), pa.nulls(n_rows, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "id", "th", "h", "n", "digest"],
            )
            if found:
                row, h = np.concatenate(found, axis=1)
                _, at, count = np.unique(mix(h + row * np.uint64(MIX_1)), return_index=True, return_counts=True)
                row, h = row[at].astype(np.int64), h[at].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(row), batch.schema.field("doc_id").type), pa.array(ids[row]), pa.array(ths[row]), pa.array(h), pa.array(count, pa.int64()), pa.nulls(len(row), pa.string())],
                    ["doc_id", "id", "th", "h", "n", "digest"],
                )

    return scan


def _content_hash(content: bytes, windows: int) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8, salt=windows.to_bytes(8, "little")).digest(), "little", signed=True)


def fragments(kind: Kind, common: np.ndarray) -> Callable:
    """Second scan, over documents with their repeated anchors ``hs``.

    Rows with ``fragment``: its anchor, hash, smallest ``id``, count in this task ``n`` and windows
    ``start``; rows without: where (``id``, ``th``, ``start``) a fragment of ``n`` windows lies.
    """
    names = ["h", "f", "id", "th", "start", "n", "fragment"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, units = Hasher(), Units(kind, Hasher(), word_table())
        sent: dict[tuple[int, int], list] = {}
        size = 0

        def flush():
            some = list(sent.items())
            for at in range(0, len(some), 4000):
                part = some[at : at + 4000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[1] for k, _ in part], pa.int64()), pa.array([v[0] for _, v in part], pa.int64()), pa.nulls(len(part), pa.int64()), pa.array([v[3] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64()), pa.array([v[2] for _, v in part], pa.binary())],
                    names,
                )
            sent.clear()

        for batch in slices(batches):
            units.load(batch.column("text"))
            ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            hs = batch.column("hs").to_pylist()
            where: list[tuple] = []
            for lo, hi in pieces(units.first, kind):
                rows, first = _within(units.first, lo, hi)
                values = units.values[lo:hi]
                _, least = anchors(values, first, kind, hasher)
                starts, ends = _runs(least, first)
                if not len(starts):
                    continue
                row = rows[np.searchsorted(first, starts, side="right") - 1]
                known = np.zeros(len(starts), bool)
                cut = np.flatnonzero(np.diff(row)) + 1
                for a, b in zip(np.append(0, cut), np.append(cut, len(row)), strict=True):
                    known[a:b] = np.isin(least[starts[a:b]], np.array(hs[row[a]], np.int64).view(np.uint64))
                if len(common) and known.any():
                    keep = np.zeros(len(least), bool)
                    for a, b in zip(starts[known], ends[known], strict=True):
                        keep[a:b] = True
                    _, least = anchors(values, first, kind, hasher, common)
                    starts, ends = _runs(np.where(keep, least, TOP), first)
                    row = rows[np.searchsorted(first, starts, side="right") - 1]
                    known = np.ones(len(starts), bool)
                for s, e, r in zip(starts[known].tolist(), ends[known].tolist(), row[known].tolist(), strict=True):
                    content = units.content(lo + s, min(lo + e + kind.reach - 1, int(units.first[r + 1])))
                    key = (int(least[s].astype(np.int64)), _content_hash(content, e - s))
                    where.append((*key, int(ids[r]), int(ths[r]), lo + s - int(units.first[r]), e - s))
                    if (had := sent.get(key)) is None:
                        sent[key] = [int(ids[r]), 1, content, e - s]
                        size += len(content)
                    else:
                        had[0], had[1] = min(had[0], int(ids[r])), had[1] + 1
            if where:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*where, strict=True)] + [pa.nulls(len(where), pa.binary())], names)
            if size > TASK_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return scan


def buckets(kind: Kind, index: Callable) -> Callable:
    """Fragments sorted by anchor to verdicts: ``h, f`` and runs ``lo, hi, least`` of strings of ``width`` units that repeat.

    ``index(contents, anchors, ids, counts, windows)`` works on all fragments of some anchors at once and
    yields, per fragment that has any, its number and its runs.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size, now = 0, None

        def work():
            keys = list(held)
            rows = []
            of = [np.array([held[k][c] for k in keys]) for c in (0, 1, 3)]
            for i, runs in index([held[k][2] for k in keys], np.array([k[0] for k in keys]), *of):
                rows.append((*keys[i], runs))
            held.clear()
            if rows:
                runs = pa.array([r[2] for r in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("least", pa.int64()), ("width", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), runs], ["h", "f", "runs"])

        for batch in batches:
            for h, f, i, n, content, windows in zip(*(batch.column(c).to_pylist() for c in ("h", "f", "id", "n", "fragment", "start")), strict=True):
                if h != now and size >= BUCKET_BYTES:
                    yield from work()
                    size = 0
                now = h
                if (had := held.get((h, f))) is None:
                    held[h, f] = [i, n, content, windows]
                    size += len(content)
                else:
                    had[0], had[1] = min(had[0], i), had[1] + n
        if held:
            yield from work()

    return scan


def _covered(spans: list[dict], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [s["s"] for s in spans], 1)
    np.add.at(edge, [s["e"] for s in spans], -1)
    return np.cumsum(edge)[:n] > 0


def repeated(docs: DataFrame, kind: Kind, index: Callable, summary: Callable, finish: Callable, schema: str, common: int = COMMON) -> DataFrame:
    """``schema`` for every document, null where nothing repeats, beside ``n`` and ``digest`` of the whole text.

    ``summary(units)`` gives lengths and digests of a slice; ``finish(units, row, covered, later, short)``
    makes a row of ``schema`` from a text, the mask of its units that lie in a repeated string of
    ``kind.reach`` units, the mask of those in one that a smaller document holds too, and the mask of
    those in a window, however short, that a smaller document holds too.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    kept = docs.schema["doc_id"].dataType.simpleString()
    scanned = stored(rows.mapInArrow(seeds(kind, summary), f"doc_id {kept}, id long, th long, h long, n long, digest string"), "seeds")
    found = scanned.filter("h IS NOT NULL").select("h", "id", "th", "n")
    again = F.min("id") < F.max("id") if kind.documents else F.sum("n") > 1
    counted = stored(found.groupBy("h").agg(F.sum("n").alias("times"), again.alias("again")).filter("again").select("h", "times"), "anchors")
    most = max(common, int((found.agg(F.count("*")).first()[0] or 0) / 10_000))
    # at most ten thousand anchors can be this common
    often = np.array(sorted(int(r[0]) for r in counted.filter(F.col("times") > most).select("h").collect()), np.uint64)
    mine = found.join(counted, "h").groupBy("id", "th").agg(F.collect_set("h").alias("hs"))
    candidates = stored(rows.join(mine, ["id", "th"]), "candidates")
    # shuffles of finished steps are dropped once Python and then the JVM let their plans go; else they lie beside the fragments
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    cut = stored(candidates.select("id", "th", "text", "hs").mapInArrow(fragments(kind, _as_grams(often)), "h long, f long, id long, th long, start long, n long, fragment binary"), "fragments")
    content = cut.filter("fragment IS NOT NULL").select("h", "f", "id", "n", "start", "fragment").repartition(lanes(spark), "h").sortWithinPartitions("h")
    verdicts = content.mapInArrow(buckets(kind, index), "h long, f long, runs array<struct<lo:long,hi:long,least:long,width:long>>")
    lie = cut.filter("th IS NOT NULL").select("h", "f", "id", "th", "start")
    hit = lie.join(verdicts, ["h", "f"])
    runs = F.filter("runs", lambda r: (r["least"] < F.col("id")) | F.lit(not kind.documents) & (r["width"] == kind.reach))
    placed = F.transform(runs, lambda r: F.struct((F.col("start") + r["lo"]).alias("s"), (F.col("start") + r["hi"] + r["width"] - 1).alias("e"), (r["least"] < F.col("id")).alias("later"), (r["width"] == kind.reach).alias("whole")))
    spans = hit.select("id", "th", placed.alias("spans")).filter(F.size("spans") > 0)
    marked = spans.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(kind, Hasher(), word_table())
        for batch in slices(batches):
            units.load(batch.column("text"))
            out = []
            for r, spans in enumerate(batch.column("spans").to_pylist()):
                n = int(units.first[r + 1] - units.first[r])
                whole, later = ([s for s in spans if s[told]] for told in ("whole", "later"))
                out.append(finish(units, r, _covered(whole, n), _covered([s for s in whole if s["later"]], n), _covered(later, n)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), batch.column("th"), *(pa.array(c) for c in zip(*out, strict=True))], names)

    names = ["doc_id", "id", "th", *(part.strip().split(" ")[0] for part in schema.split(","))]
    changed = candidates.select("doc_id", "id", "th", "text").join(marked, ["id", "th"]).mapInArrow(apply, f"doc_id {kept}, id long, th long, {schema}")
    whole = scanned.filter("h IS NULL").select("doc_id", "id", "th", "n", "digest")
    return whole.join(changed.drop("doc_id").dropDuplicates(["id", "th"]), ["id", "th"], "left")


def _as_grams(order: np.ndarray) -> np.ndarray:
    """Anchors are gram hashes without their lowest bit: both grams that an anchor may stand for."""
    return np.sort(np.concatenate([order << np.uint64(1), (order << np.uint64(1)) | np.uint64(1)]))
