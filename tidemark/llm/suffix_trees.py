"""Substring dedup by suffix trees over words, partitioned by anchors.

Suffixes are partitioned not by prefixes of variable length but by the anchor gram of their window
(see ``repeats``), or where that one is too common the next anchor. Each task holds a bounded group of
them and grows their subtree from the root down: a node is the set of suffixes that share its
path, every level adds words to the path, and a node with one suffix left is a leaf and is not
followed. Nodes as deep as the window are the maximal repeats' inner nodes; each knows the smallest
document below it.

Removed are words covered by a window of 50 words that also starts in a document with a smaller
doc_id. Rows: a null or wordless text has no words; a text under 50 words keeps all; a null doc_id
is larger than all others; rows with one doc_id are one document; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MIX_1, Hasher, mix, word_table, words
from tidemark.llm.repeats import COMMON, Kind, Units, repeated

WINDOW, GRAM = 50, 10


def levels(window: int) -> list[int]:
    """Depths at which nodes are split: doubling, then the window."""
    out = [8]
    while out[-1] * 2 < window:
        out.append(out[-1] * 2)
    return [d for d in out if d < window] + [window]


def subtree(values: np.ndarray, suffixes: np.ndarray, group: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes below an inner node of depth ``window``, and the number of that node.

    ``values`` are word hashes, ``suffixes`` positions in them, ``group`` the path each starts with.
    """
    alive = np.arange(len(suffixes))
    node = mix(group.astype(np.uint64))
    blocks = {1: values}
    depth = 0
    for goal in levels(window):
        while depth < goal:
            step = 1
            while step * 2 <= goal - depth:
                step *= 2
            while step not in blocks:
                half = max(blocks)
                b = blocks[half]
                blocks[half * 2] = mix(b[: len(b) - half] * np.uint64(MIX_1) + b[half:]) if len(b) > half else b[:0]
            node = mix(node * np.uint64(31) + blocks[step][suffixes[alive] + depth])
            depth += step
        order = np.sort(node)
        inner = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(inner):
            return alive[:0], alive[:0]
        at = np.minimum(np.searchsorted(inner, node), len(inner) - 1)
        stay = inner[at] == node
        alive, node, at = alive[stay], node[stay], at[stay]
    return alive, at


def index(window: int = WINDOW):
    """Verdicts for fragments: per window, the smallest document it starts in."""

    def work(contents: list[bytes], anchor: np.ndarray, ids: np.ndarray, counts: np.ndarray, windows: np.ndarray) -> Iterator[tuple[int, list[dict]]]:
        flat = np.frombuffer(b" ".join(contents), np.uint8)
        lengths = np.array([len(c) for c in contents])
        offs = np.concatenate([[0], np.cumsum(lengths + 1)])
        offs[-1] -= 1
        starts, ends, first = words(flat, offs, word_table())
        values = Hasher().spans(flat, starts, ends)
        n = windows
        base = np.concatenate([[0], np.cumsum(n)])
        owner = np.repeat(np.arange(len(n)), n)
        suffixes = np.repeat(first[:-1], n) + np.arange(base[-1]) - base[owner]
        least = ids[owner].copy()
        alive, node = subtree(values, suffixes, anchor[owner], window)
        if len(alive):
            low = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, node, least[alive])
            least[alive] = low[node]
        told = np.flatnonzero((counts > 1) | (np.minimum.reduceat(least, base[:-1]) < ids))
        for i in told.tolist():
            part = least[base[i] : base[i + 1]]
            cut = np.append(0, np.flatnonzero(np.diff(part)) + 1).tolist()
            yield i, [{"lo": a, "hi": b, "least": int(part[a]), "width": window} for a, b in zip(cut, [*cut[1:], len(part)], strict=True)]

    return work


def _summary(units: Units) -> tuple[list[int], list[str]]:
    texts = (units.flat[a:b].tobytes() for a, b in zip(units.offs[:-1], units.offs[1:], strict=True))
    return np.diff(units.first).tolist(), [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]


def _finish(units: Units, row: int, covered: np.ndarray, later: np.ndarray, short: np.ndarray) -> tuple[int, str]:
    found = units.flat[units.offs[row] : units.offs[row + 1]].tobytes().split()
    kept = b" ".join(w for w, gone in zip(found, covered.tolist(), strict=True) if not gone)
    return int(covered.sum()), hashlib.sha256(kept).hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, common: int = COMMON) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    kind = Kind("word", window, min(gram, window), True, window)
    found = repeated(docs, kind, index(window), _summary, _finish, "n_removed long, kept_sha256 string", common)
    return found.select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"))


OP2_SQL = """
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (k) WHERE first < doc_id)),
placed AS (SELECT doc_id, len(w) AS n_words, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT p.doc_id, count(g.p) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.p) FILTER (WHERE g.p IS NULL), '') AS text
         FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
