"""SimHash near-duplicates by a binary trie self-join.

Fingerprints that differ in at most three of 64 bits agree on one of four 16-bit blocks, so four
tries, each with another block on top, hold every link below an equal root path. Each root's
subtree is one group; inside it pairs of nodes are followed down together, the differing bits are
added up, and a pair is dropped once they exceed the budget. A root with very many fingerprints is
split by eight more bits into pairs of subtrees within the budget.

Rows: a null or wordless text has fingerprint zero and links like any other; a null doc_id counts
only where a component has no other; repeated rows get the same component; an empty table gives
no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LAST_ID, hex64, keyed, lanes, stored
from tidemark.llm.components import components

BITS, BLOCK, BUDGET, WIDTH = 64, 16, 3, 3
#: A root with more fingerprints is split by eight more bits.
WIDE_ROOT = 200_000
#: Node pairs followed at once.
FRONT = 1 << 18


def text_fingerprint(text: bytes, digest, width: int = WIDTH) -> bytes:
    """Eight bytes: the majority of each bit over the shingles' hashes."""
    w = text.lower().split()
    if not w:
        return bytes(8)
    if len(w) < width:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False))
    hashes = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, id, th`` of every row with its fingerprint ``fp`` as a signed long."""

    def sign(batches):
        from xxhash import xxh64_digest

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            prints = b"".join(text_fingerprint(t or b"", xxh64_digest) for t in texts)
            fp = np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), batch.column("th"), pa.array(fp)], ["doc_id", "id", "th", "fp"])

    kept = keyed(docs)
    return kept.mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, id long, th long, fp long")


def _labels(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; parent holds each element's smallest member."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        hook = np.arange(len(parent))
        np.minimum.at(hook, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            again = hook[hook]
            if (again == hook).all():
                break
            hook = again
        parent = hook[parent]


def trie_join(keys: np.ndarray, nodes: list[tuple[np.ndarray, ...]], depth: int, budget: int = BUDGET) -> np.ndarray:
    """Smallest linked index of each of the sorted, distinct ``keys``.

    ``nodes`` are arrays a_lo, a_hi, b_lo, b_hi, errors of node pairs at ``depth`` (a pair of a node
    with itself has equal ranges). A pair whose members are all in one set already adds nothing.
    """
    parent = np.arange(len(keys))
    stack = [(depth, *nodes)]
    while stack:
        d, *pair = stack.pop()
        if len(pair[0]) > FRONT:
            stack.append((d, *(x[FRONT:] for x in pair)))
            pair = [x[:FRONT] for x in pair]
        al, ah, bl, bh, err = pair
        change = np.zeros(len(keys) + 1, np.int64)
        np.cumsum(parent[1:] != parent[:-1], out=change[1 : len(keys)])
        one = (change[al] == change[ah - 1]) & (change[bl] == change[bh - 1]) & (parent[al] == parent[bl])
        live = ~one & (err <= budget)
        al, ah, bl, bh, err = (x[live] for x in (al, ah, bl, bh, err))
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            parent = _labels(parent, i[near], j[near])
            al, ah, bl, bh, err = (x[~leaf] for x in (al, ah, bl, bh, err))
        if not len(al) or d == BITS:
            continue
        bit = np.uint64(1 << (BITS - 1 - d))
        high = np.uint64(((1 << d) - 1) << (BITS - d)) if d else np.uint64(0)
        am, bm = (np.searchsorted(keys, (keys[lo] & high) | bit) for lo in (al, bl))
        same = al == bl
        sides = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        cross = (am, ah, bl, bm, err + 1)
        grown = [np.concatenate([*(s[k] for s in sides), cross[k][~same]]) for k in range(5)]
        full = (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] <= budget)
        if full.any():
            stack.append((d + 1, *(x[full] for x in grown)))
    return parent


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x if by % 64 == 0 else (x << np.uint64(by % 64)) | (x >> np.uint64(64 - by % 64))


def _group_links(turn: int, turned: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Links to each set's smallest key. mask: -1 for whole roots, else the bits in which a pair of split subtrees differs."""
    keys = np.unique(turned)
    whole = mask < 1
    depth = BLOCK if mask < 0 else BLOCK + 8
    cut = np.flatnonzero(np.diff(keys >> np.uint64(BITS - depth))) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
    if whole:
        nodes = (lo, hi, lo, hi, np.zeros(len(lo), np.int64))
    elif len(lo) < 2:
        return keys[:0], keys[:0]
    else:
        nodes = (lo[:1], hi[:1], lo[1:2], hi[1:2], np.array([bin(mask).count("1")]))
    parent = trie_join(keys, nodes, depth)
    linked = np.flatnonzero(parent != np.arange(len(keys)))
    back = -BLOCK * turn
    return _turn(keys[linked], back), _turn(keys[parent[linked]], back)


def _link_groups(batches):
    """Rows come sorted by turn, mask and group; groups are gathered until there is enough to work on."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray):
        # whole roots of one turn are one forest; a split pair is its own group
        kind = np.where(rows[:, 2] < 0, 0, rows[:, 1])
        cut = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 2]) != 0) | (np.diff(kind) != 0)) + 1
        for part in np.split(rows, cut):
            u, v = _group_links(int(part[0, 0]), part[:, 3].view(np.uint64), int(part[0, 2]))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = np.ascontiguousarray(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("turn", "grp", "mask", "turned")], axis=1))
        held.append(rows)
        if sum(map(len, held)) >= WIDE_ROOT:
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield from flush(rows[:end])
            held = [rows[end:]]
    if held and sum(map(len, held)):
        yield from flush(np.concatenate(held))


def links(prints: DataFrame, wide_root: int = WIDE_ROOT) -> DataFrame:
    """Distinct fingerprints ``fp`` to links ``(u, v)`` that connect all within the budget (a forest per group)."""
    turns = F.explode(F.array(*(F.struct(F.lit(t).alias("turn"), (F.shiftleft("fp", BLOCK * t).bitwiseOR(F.shiftrightunsigned("fp", BITS - BLOCK * t)) if t else F.col("fp")).alias("turned")) for t in range(BITS // BLOCK))))
    rooted = prints.select(turns.alias("x")).select("x.*", F.shiftrightunsigned("x.turned", BITS - BLOCK).alias("root"))
    wide = rooted.groupBy("turn", "root").agg(F.count("*").alias("n")).filter(F.col("n") > wide_root).select("turn", "root", F.lit(True).alias("wide"))
    marked = rooted.join(wide, ["turn", "root"], "left")
    masks = [m for m in range(256) if bin(m).count("1") <= BUDGET]
    path = F.shiftrightunsigned("turned", BITS - BLOCK - 8)
    split = F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(m.alias("mask"), F.least(path, path.bitwiseXOR(m.cast("long"))).alias("grp")))
    whole = F.array(F.struct(F.lit(-1).alias("mask"), F.col("root").alias("grp")))
    groups = marked.select("turn", "turned", F.explode(F.when(F.col("wide"), split).otherwise(whole)).alias("g")).select("turn", "g.grp", "g.mask", "turned")
    dealt = groups.repartition(lanes(prints.sparkSession), "turn", "grp", "mask").sortWithinPartitions("turn", "mask", "grp")
    return dealt.mapInArrow(_link_groups, "u long, v long")


def near_duplicates(docs: DataFrame, wide_root: int = WIDE_ROOT) -> DataFrame:
    """``doc_id, id, th, fp, root, component_id`` of every row; root names the component, component_id is its smallest doc_id."""
    rows = stored(fingerprints(docs), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    stars = components(links(prints.select("fp"), wide_root))
    root = prints.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(root.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group stays: its smallest doc_id, one row of it. Columns as given.

    Two texts of one group under one doc_id: the one with the smaller hash stays.
    """
    found = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("id", "root").agg(F.min("th").alias("th")).select("id", "th")
    rows = docs.withColumns({"__key_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "__key_th": F.xxhash64("text")})
    joined = rows.join(kept, (rows["__key_id"] == kept.id) & (rows["__key_th"] == kept.th), "left_semi")
    return joined.dropDuplicates(["__key_id", "__key_th"]).select(*docs.columns)


def op1_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex64("fp").alias("fingerprint"), "component_id")
