"""Benchmark decontamination with suffix arrays over the training documents.

Every slice of documents is a shard: its word suffixes are sorted by their first three words (a
14-bit hash each, so an order of suffixes over a smaller alphabet), and every distinct window of the
benchmark (13 words, or a whole shorter item) is looked up by binary search. The document suffixes
found, each once, and the windows are then ordered together word by word to the windows' depth; a
suffix that ends in a window's class is an occurrence. No pair of a suffix and an item is formed, so
the work does not grow with repeats on both sides. Documents are never split over shards, so no
shuffle is needed; the benchmark passes through the driver to the tasks in blocks of a checked size,
one at a time.

Rows: a null text has no words and is clean; a null item text matches nothing; a null item_id
counts as the empty string, repeated item_ids as one item; repeated documents are judged alike; an
empty benchmark leaves every document clean; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LAST_ID, Hasher, keyed, raw, slices, stored, word_table, words

WINDOW, SHARE = 13, 20
PREFIX, PREFIX_BITS = 3, 14
#: Benchmark text sent to the tasks at once.
BLOCK_BYTES = 8 << 20
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


#: The longest verbatim match of a row: words, first word in the row, item, first word in the item.
LONGEST = ("longest", "longest_at", "longest_item", "longest_item_at")
NO_MATCH = (0, None, None, None)


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def hashed_words(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    flat, offs = raw(column)
    flat = lower_table()[flat]
    starts, ends, first = words(flat, offs, word_table(SEPARATORS))
    return hasher.spans(flat, starts, ends), first


def prefix_keys(h: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first words of each suffix, most significant first; words beyond ``end`` are zero."""
    key = np.zeros(len(at), np.uint64)
    for k in range(PREFIX):
        there = at + k < end
        digit = h[np.minimum(at + k, max(len(h) - 1, 0))] >> np.uint64(64 - PREFIX_BITS) if len(h) else key
        key = (key << np.uint64(PREFIX_BITS)) | np.where(there, digit, np.uint64(0))
    return key


def narrowed(ct: np.ndarray, wt: np.ndarray, cp: np.ndarray, wp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of tests and of places after one more word (``wt``, ``wp``); -1 for places that no test goes on with."""
    if not len(ct):
        return ct, np.full(len(cp), -1, np.int64)
    known, word = np.unique(wt, return_inverse=True)
    at = np.minimum(np.searchsorted(known, wp), len(known) - 1)
    keys, ct = np.unique(ct * len(known) + word, return_inverse=True)
    key = cp * len(known) + at
    to = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return ct, np.where((known[at] == wp) & (keys[to] == key), to, -1)


def test_suffixes(items: list[tuple[str, str]], window: int = WINDOW) -> dict[str, np.ndarray]:
    """All suffixes of all items that can start an occurrence, and the distinct windows at their heads, as arrays."""
    h, first = hashed_words(pa.array([t for _, t in items], pa.string()), Hasher())
    n = np.diff(first)
    need = np.minimum(n, window)
    count = np.where(n > 0, n - need + 1, 0)
    item = np.repeat(np.arange(len(items)), count)
    begin = np.repeat(first[:-1], count)
    at = begin + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    end, need = first[1:][item], need[item]
    which, heads = np.zeros(len(at), np.int64), []
    live, ct, k, windows = np.arange(len(at)), np.zeros(len(at), np.int64), 0, 0
    while len(live):
        ct, _ = narrowed(ct, h[at[live] + k], at[:0], h[:0])
        k += 1
        done = need[live] == k
        _, head, mine = np.unique(ct[done], return_index=True, return_inverse=True)
        which[live[done]] = windows + mine
        heads.append(live[done][head])
        windows += len(head)
        live, ct = live[~done], ct[~done]
    head = np.concatenate([np.zeros(0, np.int64), *heads])
    rep, size = at[head], need[head]
    seen = np.minimum(size, PREFIX)
    low = prefix_keys(h, rep, rep + seen)
    high = low + (np.uint64(1) << (np.uint64(PREFIX_BITS) * (PREFIX - seen).astype(np.uint64)))
    # windows that occur in the same items share one list of them
    held = np.unique(which * max(len(items), 1) + item)
    owner, held = np.divmod(held, max(len(items), 1))
    edges, lists = np.searchsorted(owner, np.arange(windows + 1)).tolist(), {}
    listed = np.array([lists.setdefault(held[a:b].tobytes(), len(lists)) for a, b in zip(edges[:-1], edges[1:], strict=True)], np.int64)
    return {"h": h, "at": at, "begin": begin, "end": end, "item": item, "which": which, "rep": rep, "need": size, "low": low, "high": high, "listed": listed, "lists": [np.frombuffer(x, np.int64) for x in lists]}


def matches(h: np.ndarray, first: np.ndarray, tests: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word position and distinct window of every occurrence."""
    n = len(h)
    none = np.zeros(0, np.int64)
    if not n or not len(tests["at"]):
        return none, none
    end = np.repeat(first[1:], np.diff(first))
    key = prefix_keys(h, np.arange(n), end)
    bits = n.bit_length()
    if PREFIX * PREFIX_BITS + bits <= 64:
        order = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
        suffixes, key = (order & np.uint64((1 << bits) - 1)).astype(np.int64), order >> np.uint64(bits)
    else:
        suffixes = np.argsort(key, kind="stable")
        key = key[suffixes]
    lo, hi = np.searchsorted(key, tests["low"]), np.searchsorted(key, tests["high"])
    t = np.flatnonzero(hi > lo)
    within = np.cumsum(np.bincount(lo[t], minlength=n + 1) - np.bincount(hi[t], minlength=n + 1))[:n] > 0
    p = suffixes[within]
    ct, cp = np.zeros(len(t), np.int64), np.zeros(len(p), np.int64)
    places, found, k = [none], [none], 0
    while len(t) and len(p):
        inside = p + k < end[p]
        p, cp = p[inside], cp[inside]
        ct, cp = narrowed(ct, tests["h"][tests["rep"][t] + k], cp, h[p + k])
        p, cp = p[cp >= 0], cp[cp >= 0]
        k += 1
        done = tests["need"][t] == k
        whole, live = np.full(len(t), -1), np.zeros(len(t), bool)
        whole[ct[done]] = t[done]
        places.append(p[whole[cp] >= 0])
        found.append(whole[cp][whole[cp] >= 0])
        live[cp] = True
        going = ~done & live[ct]
        t, ct = t[going], ct[going]
    return np.concatenate(places), np.concatenate(found)


def longest_matches(h: np.ndarray, first: np.ndarray, tests: dict[str, np.ndarray], p: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row, the length of its longest match with an item, the word it starts at and the test suffix it starts.

    ``p`` and ``window`` are the row's occurrences. Of equally long matches the first in the row is told, of
    suffixes that hold it the first by item name; rows without an occurrence have length 0.
    """
    size, place, suffix = np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int64)
    row = np.searchsorted(first, p, side="right") - 1
    need = tests["need"][window]
    order = np.lexsort((p, -need, row))
    p, row, window, need = p[order], row[order], window[order], need[order]
    windows, head = np.unique(tests["which"], return_index=True)

    def tell(k: int | np.ndarray, p: np.ndarray, row: np.ndarray, q: np.ndarray) -> None:
        rows, at = np.unique(row, return_index=True)
        size[rows], place[rows], suffix[rows] = k if np.isscalar(k) else k[at], p[at], q[at]

    tell(need, p, row, head[np.searchsorted(windows, window)])
    k = int(tests["need"].max(initial=0))
    deep = need == k
    p, row, cp = p[deep], row[deep], window[deep]
    used = np.zeros(len(tests["need"]), bool)
    used[cp] = True
    q = np.flatnonzero(used[tests["which"]])
    # the longest match can't be extended to the left, so places that go on from the place before in all items are left out
    heads, at = tests["at"][q] == tests["begin"][q], tests["at"][q]
    left, w = tests["h"][np.maximum(at - 1, 0)], tests["which"][q]
    one, several = np.zeros(len(used), np.uint64), np.zeros(len(used), bool)
    one[w] = left
    several[w[heads | (one[w] != left)]] = True
    starts = several[cp] | (first[row] == p) | (h[np.maximum(p - 1, 0)] != one[cp])
    p, row, cp, ct = p[starts], row[starts], cp[starts], w
    while len(p) and len(q):
        inside, going = p + k < first[row + 1], tests["at"][q] + k < tests["end"][q]
        p, row, cp, q, ct = p[inside], row[inside], cp[inside], q[going], ct[going]
        ct, cp = narrowed(ct, tests["h"][tests["at"][q] + k], cp, h[p + k])
        p, row, cp = p[cp >= 0], row[cp >= 0], cp[cp >= 0]
        k += 1
        if len(p):
            classes, head = np.unique(ct, return_index=True)
            tell(k, p, row, q[head[np.searchsorted(classes, cp)]])
        live = np.zeros(len(q), bool)
        live[cp] = True
        q, ct = q[live[ct]], ct[live[ct]]
    return size, place, suffix


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text IS NOT NULL")
    return [texts] if n == 1 else [texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _collected(block: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """The item names and test suffixes of one block, collected behind the size check above."""
    items = sorted((r["item_id"], r["text"]) for r in block.collect())
    return [i for i, _ in items], test_suffixes(items)


def _verdict(n: int, spans: list[tuple[int, int]], items: list[str], longest: tuple) -> tuple:
    edge = np.zeros(n + 1, np.int64)
    for s, e in spans:
        edge[s] += 1
        edge[e] -= 1
    hit = int((np.cumsum(edge)[:n] > 0).sum())
    digest = hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
    return hit, len(set(items)), digest, hit > 0 and SHARE * hit >= n, *longest


def _located(batch: pa.RecordBatch, names: list[str], tests: dict[str, np.ndarray], hasher: Hasher, longest: bool) -> list[tuple[int, list[tuple[int, int]], list[str], tuple]]:
    """Per row: number of words, covered runs of words, items and, if asked for, the longest match as in ``LONGEST``."""
    h, first = hashed_words(batch.column("text"), hasher)
    out = [[int(n), [], [], NO_MATCH] for n in np.diff(first)]
    p, window = matches(h, first, tests)
    if not len(p):
        return out
    covered = np.cumsum(np.bincount(p, minlength=len(h) + 1) - np.bincount(p + tests["need"][window], minlength=len(h) + 1))[:-1] > 0
    opens = np.zeros(len(h) + 1, bool)
    opens[first] = True
    starts = np.flatnonzero(covered & (opens[:-1] | ~np.append(False, covered[:-1])))
    ends = np.flatnonzero(covered & (opens[1:] | ~np.append(covered[1:], False))) + 1
    rows = np.searchsorted(first, starts, side="right") - 1
    for r, s, e in zip(rows.tolist(), (starts - first[rows]).tolist(), (ends - first[rows]).tolist(), strict=True):
        out[r][1].append((s, e))
    lists = len(tests["lists"])
    told: dict[int, set[int]] = {}
    for r, i in zip(*(x.tolist() for x in np.divmod(np.unique((np.searchsorted(first, p, side="right") - 1) * lists + tests["listed"][window]), lists)), strict=True):
        told.setdefault(r, set()).update(tests["lists"][i].tolist())
    for r, held in told.items():
        out[r][2] = sorted({names[i] for i in held})
    if longest:
        size, place, suffix = longest_matches(h, first, tests, p, window)
        for r in np.flatnonzero(size).tolist():
            q = suffix[r]
            out[r][3] = int(size[r]), int(place[r] - first[r]), names[tests["item"][q]], int(tests["at"][q] - tests["begin"][q])
    return out


def judge(docs: DataFrame, benchmark: DataFrame, longest: bool = True) -> DataFrame:
    """``doc_id, id, th, n_words, n_hit, n_items, items_sha256, contaminated`` and the columns of ``LONGEST`` of every row.

    The longest match is 0 words, its places null, where nothing occurs or it is not asked for. Of equally long
    matches the first in the row is told, of items that hold it the first by name.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs)
    told = "longest long, longest_at long, longest_item string, longest_item_at long"
    schema = f"doc_id {kind}, id long, th long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, {told}"
    blocks = _blocks(benchmark)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64())

    def verdicts(batch: pa.RecordBatch, found: list[tuple[int, list, list, tuple]]) -> pa.RecordBatch:
        judged = [(n, *_verdict(n, spans, items, most)) for n, spans, items, most in found]
        columns = [pa.array(c, t) for c, t in zip(zip(*judged, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), batch.column("th"), *columns], ["doc_id", "id", "th", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *LONGEST])

    if len(blocks) == 1:
        names, tests = _collected(blocks[0])

        def scan(batches):
            hasher = Hasher()
            for batch in slices(batches):
                yield verdicts(batch, _located(batch, names, tests, hasher, longest))

        return rows.mapInArrow(scan, schema)

    def locate(names, tests):
        def scan(batches):
            hasher = Hasher()
            for batch in slices(batches):
                found = [(i, *f) for i, f in enumerate(_located(batch, names, tests, hasher, longest)) if f[1]]
                if found:
                    at = pa.array([f[0] for f in found])
                    most = [pa.array(c, t) for c, t in zip(zip(*(f[4] for f in found), strict=True), types[5:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(at), batch.column("th").take(at), pa.array([[list(s) for s in f[2]] for f in found], pa.list_(pa.list_(pa.int64()))), pa.array([f[3] for f in found], pa.list_(pa.string())), *most],
                        ["id", "th", "spans", "items", *LONGEST],
                    )

        return rows.mapInArrow(scan, f"id long, th long, spans array<array<long>>, items array<string>, {told}")

    def merge(batches):
        for batch in slices(batches):
            _, first = hashed_words(batch.column("text"), Hasher())
            spans, items, *most = (batch.column(c).to_pylist() for c in ("spans", "items", *LONGEST))
            yield verdicts(batch, [(int(n), s or [], i or [], (m[0] or 0, *m[1:])) for n, s, i, m in zip(np.diff(first), spans, items, zip(*most, strict=True), strict=True)])

    # one block at a time is on the driver: its matches are stored before the next is collected
    parts = [stored(locate(*_collected(b)), "benchmark-matches") for b in blocks]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    best = F.min(F.struct((-F.col("longest")).alias("longest"), *LONGEST[1:]))
    merged = union.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), best.alias("best"))
    merged = merged.select("id", "th", "spans", "items", (-F.col("best.longest")).alias("longest"), *(F.col(f"best.{c}") for c in LONGEST[1:]))
    return rows.join(merged, ["id", "th"], "left").mapInArrow(merge, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean documents, in their own columns and order of partitions."""
    blocks = _blocks(benchmark)
    if len(blocks) > 1:
        bad = judge(docs, benchmark, longest=False).filter("contaminated").select("id", "th").distinct()
        rows = docs.withColumns({"__key_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "__key_th": F.xxhash64("text")})
        return rows.join(bad, (rows["__key_id"] == bad.id) & (rows["__key_th"] == bad.th), "left_anti").select(*docs.columns)
    names, tests = _collected(blocks[0])

    def scan(batches):
        hasher = Hasher()
        for batch in slices(batches):
            bad = [_verdict(*f)[3] for f in _located(batch, names, tests, hasher, False)]
            yield batch.filter(pa.array([not b for b in bad]))

    return docs.mapInArrow(scan, docs.schema)


def op9_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The verdicts with the longest verbatim match of each document and where it lies."""
    return judge(docs, benchmark).drop("id", "th")


OP9_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
heads AS (
  SELECT item, text, n, j, array_to_string(w[j:j + n - 1], ' ') AS k
  FROM (SELECT item, text, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS j FROM items WHERE len(w) > 0)),
tests AS (SELECT DISTINCT item, n, k FROM heads),
sizes AS (SELECT DISTINCT n FROM tests),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
keys AS (SELECT doc_id, n, i, k FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM places) SEMI JOIN tests USING (n, k)),
hits AS (SELECT DISTINCT doc_id, i, p.n, item FROM keys p JOIN tests t ON p.n = t.n AND p.k = t.k),
lines AS (
  SELECT doc_id, item, text, n, i, j, i - row_number() OVER (PARTITION BY doc_id, item, text, i - j ORDER BY i) AS run
  FROM keys JOIN heads USING (n, k)),
runs AS (SELECT doc_id, item, text, count(*) + max(n) - 1 AS size, min(i) - 1 AS doc_at, min(j) - 1 AS item_at FROM lines GROUP BY doc_id, item, text, i - j, run),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, doc_at, item, text, item_at) = 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(size, 0)::BIGINT AS longest, doc_at::BIGINT AS longest_at, best.item AS longest_item, item_at::BIGINT AS longest_item_at
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)
"""
