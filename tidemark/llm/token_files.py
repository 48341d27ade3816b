"""Token-id files in a word-aligned packing (simple-8b).

A document's ids are cut into blocks of 120; each block is a run of 64-bit words whose top four
bits say how many ids of how many bits follow (1 to 60 ids of 60 to 1 bits). An id of over 60 bits
is escaped: a word with the escape selector, then the id itself. Beside the words stand the offsets
of the blocks, so all blocks of a file batch decode at once.

Files are Parquet, one row per document in ascending doc_id order (then text hash; null doc_ids
last) over ordered shards: ``doc_id, n, at`` (ids before it in its shard), ``shard``, ``offsets``
(unsigned 32-bit per block), ``words`` (little-endian). Texts are tokenized word by word with a
memory by 64-bit hash: the vocabulary's rules never join across white space, and a closing mark is only split
off behind characters that the rules part from it, so this equals encoding the text.

Rows: a null or empty text has only the end id; repeated rows are written as often as they come;
an empty table writes no rows; other columns are not read.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, Hasher, keyed, lanes, raw, slices, word_table
from tidemark.llm.common import words as words_of
from tidemark.session import literal_frame, scratch_path

#: Fixed values of the coding: ids per word and bits per id, by selector; the escape selector.
PACKINGS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 15
BLOCK = 120
END_ID = 1
#: ASCII marks that may close a word; none of them occurs in the vocabulary's special strings next to a space.
MARKS = b".,;:!?%$#&*"
#: Words that a worker remembers at most, about 35 MB; then it starts anew.
CACHE_WORDS = 1_000_000
#: Words tokenized at once; the library holds far more than the ids of each.
CHUNK_WORDS = 2_000
#: Composed Latin letters whose lower case is one letter.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+")


def encode(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pack documents of ``counts`` ids each: words, words per document, block offsets, blocks per document."""
    blocks = -(-counts // BLOCK)
    n = int(blocks.sum())
    doc = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(n) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = (np.cumsum(counts) - counts)[doc] + nth * BLOCK
    length = np.minimum(counts[doc] - nth * BLOCK, BLOCK)
    wide = np.zeros((n, BLOCK + 60), np.uint64)
    place = np.arange(BLOCK)
    there = place < length[:, None]
    wide[:, :BLOCK][there] = ids
    small = np.zeros(1 << 16, np.uint8)
    for b in range(16):
        small[1 << b :] = b + 1
    bits = small[np.minimum(wide, np.uint64((1 << 16) - 1)).astype(np.uint16)]
    large = np.nonzero(wide >> np.uint64(16))
    if len(large[0]):
        values = wide[large]
        bits[large] = sum((values >> np.uint64(b) > 0).astype(np.uint8) for b in range(64))
    choice = np.full((n, BLOCK), ESCAPE, np.uint8)
    for selector in range(14, 0, -1):
        count, size = PACKINGS[selector]
        span, most = 1, bits
        while span * 2 <= count:
            most = np.maximum(most[:, :-span], most[:, span:])
            span *= 2
        if span < count:
            most = np.maximum(most[:, : BLOCK + 1], most[:, count - span : count - span + BLOCK + 1])
        choice[most[:, :BLOCK] <= size] = selector
    ids_per = np.array([0] + [PACKINGS[s][0] for s in range(1, 15)] + [1])
    rows, steps, froms = [], [], []
    live, at, step = np.arange(n), np.zeros(n, np.int64), 0
    live = live[length > 0]
    while len(live):
        rows.append(live)
        froms.append(at[live])
        steps.append(np.full(len(live), step))
        at[live] += ids_per[choice[live, at[live]]]
        live = live[at[live] < length[live]]
        step += 1
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64), np.zeros(n, np.uint32), blocks
    row, frm, stp = (np.concatenate(x) for x in (rows, froms, steps))
    order = np.argsort(row * (BLOCK + 1) + stp, kind="stable")
    row, frm = row[order], frm[order]
    selector = choice[row, frm]
    words = np.zeros(len(row), np.uint64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        count, size = PACKINGS.get(s, (0, 0))
        word = np.full(len(mine), s << 60, np.uint64)
        for k in range(count):
            word |= wide[row[mine], frm[mine] + k] << np.uint64(size * k)
        words[mine] = word
    if (selector == ESCAPE).any():
        more = np.where(selector == ESCAPE, 2, 1)
        raw_at = np.cumsum(more)[selector == ESCAPE] - 1
        values = wide[row, frm][selector == ESCAPE]
        words, row = np.repeat(words, more), np.repeat(row, more)
        words[raw_at] = values
    per_block = np.bincount(row, minlength=n)
    before = np.cumsum(per_block) - per_block
    per_doc = np.bincount(doc, weights=per_block, minlength=len(counts)).astype(np.int64)
    offsets = (before - np.repeat(np.cumsum(per_doc) - per_doc, blocks)).astype(np.uint32)
    return words, per_doc, offsets, blocks


def decode(words: np.ndarray, per_doc: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All ids of documents packed by ``encode``, in order."""
    blocks = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first_word = (np.cumsum(per_doc) - per_doc)[doc] + offsets.astype(np.int64)
    first_id = (np.cumsum(counts) - counts)[doc] + nth * BLOCK
    last_id = first_id + np.minimum(counts[doc] - nth * BLOCK, BLOCK)
    out = np.zeros(int(counts.sum()), np.uint64)
    if not len(words):
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    kept = np.ones(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if kept[i]:
            kept[i + 1] = False
    ids_per = np.array([0] + [PACKINGS[s][0] for s in range(1, 15)] + [1])
    count = np.where(kept, ids_per[selector], 0)
    before = np.cumsum(count) - count
    block = np.searchsorted(first_word, np.arange(len(words)), side="right") - 1
    at = first_id[block] + before - before[first_word[block]]
    stop = last_id[block]
    for s in np.unique(selector[kept]).tolist():
        mine = np.flatnonzero(kept & (selector == s))
        if s == ESCAPE:
            out[at[mine]] = words[mine + 1]
            continue
        n, size = PACKINGS[s]
        mask = np.uint64((1 << size) - 1)
        for k in range(n):
            to = at[mine] + k
            inside = to < stop[mine]
            out[to[inside]] = (words[mine[inside]] >> np.uint64(size * k)) & mask
    return out


def byte_letters() -> dict[int, int]:
    """The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


def last_characters(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The characters that end at ``ends``, their UTF-8 bytes read as one number each."""
    out = flat[ends - 1].astype(np.int64)
    more = (out & 0xC0) == 0x80
    for k in range(1, 4):
        byte = flat[np.maximum(ends - 1 - k, 0)].astype(np.int64)
        out |= np.where(more, byte << (8 * k), 0)
        more &= (byte & 0xC0) == 0x80
    return out


def loosened(flat: np.ndarray, offs: np.ndarray, apart: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before marks that close a word, so that far fewer different words remain.

    ASCII letters and a run of marks are always separate units of the vocabulary's rules; behind any
    other character a mark is only set apart where ``apart`` says that the rules do so too, as they
    join a quote, a degree sign or a vowel sign with the mark behind it. Only marks that reach up to
    white space or the text's end are set apart.
    """
    n = len(flat)
    mark, letter, space = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    mark[list(MARKS)] = letter[128:] = letter[65:91] = letter[97:123] = space[list(SPACES)] = True
    is_mark = mark[flat]
    cut = np.flatnonzero(letter[flat[:-1]] & is_mark[1:]) + 1 if n > 1 else np.zeros(0, np.int64)
    row_end = offs[np.searchsorted(offs, cut, side="right")]
    begins = np.isin(cut, offs)
    other = np.append(np.flatnonzero(~is_mark), n)
    after = other[np.searchsorted(other, cut)]
    closing = ~begins & ((after >= row_end) | space[flat[np.minimum(after, max(n - 1, 0))]])
    cut = cut[closing]
    keep = np.ones(len(cut), bool)
    beyond = flat[cut - 1] >= 128
    keep[beyond] = apart(last_characters(flat, cut[beyond]))
    cut = cut[keep]
    return np.insert(flat, cut, 32), offs + np.searchsorted(cut, offs, side="left")


def worker_state() -> dict:
    """What this worker process keeps from task to task."""
    return vars(sys.modules.setdefault("tidemark_worker_state", types.ModuleType("tidemark_worker_state")))


class Memory:
    """Words, by 64-bit hash, and their ids in flat arrays: about 35 bytes a word."""

    def __init__(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of words, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.places[at], -1).astype(np.int64)

    def add(self, h: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """New words by ascending hash."""
        at = np.searchsorted(self.keys, h)
        new = np.arange(len(self.keys), len(self.keys) + len(h), dtype=np.int32)
        self.keys, self.places = np.insert(self.keys, at, h), np.insert(self.places, at, new)
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.starts[places]
        size = self.starts[places + 1] - first
        ends = np.cumsum(size)
        return self.flat[np.repeat(first - ends + size, size) + np.arange(int(size.sum()))], size


class Tokens:
    """Ids of texts, by words that are looked up once and remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.byte_letters = self.tokenizer.model, byte_letters()
        probes = [*map(chr, range(0x41, 0x180)), "Straße", "naïve", "thing", "ŒUVRE", "Łódź"]
        probes = [p for p in probes if LATIN.fullmatch(p)]
        # words of Latin letters need no other rule than lower case and the byte alphabet, if this vocabulary is of that kind
        self.direct = all(self._latin(p) == self.tokenizer.encode(p, add_special_tokens=False).ids for p in probes)
        self.memory, self.hasher, self.inside = Memory(), Hasher(), word_table()
        self.ends_unit: dict[int, bool] = {}

    @classmethod
    def kept(cls, path: str) -> "Tokens":
        state = worker_state()
        if path not in state:
            state[path] = cls(path)
        return state[path]

    def apart(self, characters: np.ndarray) -> np.ndarray:
        """Whether the vocabulary's rules part each character from a mark behind it; asked once per character.

        The rules see normalized text, so some letters (U+0130, U+0958) end in a combining mark there.
        """
        seen, which = np.unique(characters, return_inverse=True)
        for c in seen.tolist():
            if c not in self.ends_unit:
                text = self.tokenizer.normalizer.normalize_str(c.to_bytes(-(-c.bit_length() // 8), "big").decode() + ".")
                self.ends_unit[c] = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)[-1][0] == "."
        return np.array([self.ends_unit[c] for c in seen.tolist()], bool)[which]

    def _latin(self, word: str) -> list[int]:
        """A word of Latin letters, straight through the vocabulary's merges."""
        return [t.id for t in self.model.tokenize(word.lower().encode().decode("latin-1").translate(self.byte_letters))]

    def encoded(self, words: list[bytes]) -> list[list[int]]:
        texts = [w.decode() for w in words]
        latin = [self.direct and LATIN.fullmatch(t) is not None for t in texts]
        ids: list[list[int]] = [self._latin(t) if x else [] for t, x in zip(texts, latin, strict=True)]
        other = [i for i, x in enumerate(latin) if not x]
        for at in range(0, len(other), CHUNK_WORDS):
            part = other[at : at + CHUNK_WORDS]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        return ids

    def __call__(self, flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, the end id after each, and their counts."""
        if len(self.memory.keys) > CACHE_WORDS:
            self.memory = Memory()
        starts, ends, first = words_of(flat, offs, self.inside)
        h = self.hasher.spans(flat, starts, ends)
        place = self.memory.find(h)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            text = flat.tobytes()
            ids = self.encoded([text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.memory.add(new, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
            place[missing] = self.memory.find(h[missing])
        ids, size = self.memory.ids(place)
        upto = np.concatenate([[0], np.cumsum(size)])
        counts = upto[first[1:]] - upto[first[:-1]] + 1
        out = np.full(int(counts.sum()), END_ID, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts - 1)] = ids
        return out, counts


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Tokenize and write all documents, in ascending doc_id order, as files under ``path``."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, shard, total = Tokens.kept(vocabulary), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, counts = tokens(*loosened(*raw(batch.column("text")), tokens.apart))
            words, per_doc, offsets, blocks = encode(ids.astype(np.uint64), counts)
            at = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(at, pa.int64()), pa.array(np.full(len(counts), shard), pa.int32()), _binary(offsets.astype("<u4"), blocks), _binary(words.astype("<u8"), per_doc)],
                ["doc_id", "n", "at", "shard", "offsets", "words"],
            )

    spark = docs.sparkSession
    ordered = keyed(docs).repartitionByRange(lanes(spark), "id").sortWithinPartitions("id", "th").select("doc_id", "text")
    ordered.mapInArrow(pack, f"doc_id {kind}, n long, at long, shard int, offsets binary, words binary").write.option("compression", "zstd").parquet(path)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary cell per document from a flat array."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def read_ids(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; with ``ids``, also the ids."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_id"].dataType.simpleString()
    totals = sorted((r["shard"], r["total"]) for r in files.groupBy("shard").agg(F.sum("n").alias("total")).collect())
    bases, base = [], 0
    for shard, total in totals:
        bases.append((shard, base))
        base += total
    extra = ", ids array<long>" if ids else ""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            words, per_doc, counts = batch.column("words"), None, batch.column("n").to_numpy()
            words, sizes = _values(words, "<u8")
            offsets, _ = _values(batch.column("offsets"), "<u4")
            out = decode(words, sizes, offsets, counts)
            edges = np.concatenate([[0], np.cumsum(counts)])
            data = out.astype("<u4")
            crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns, names = [batch.column("doc_id"), batch.column("shard"), batch.column("at"), batch.column("n"), pa.array(crc, pa.int64())], ["doc_id", "shard", "at", "n_tokens", "ids_crc32"]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(out.astype(np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    read = files.mapInArrow(unpack, f"doc_id {kind}, shard int, at long, n_tokens long, ids_crc32 long{extra}")
    if not bases:
        return read.select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
    # one row per shard
    known = F.broadcast(literal_frame(spark, bases, "shard int, base long"))
    return read.join(known, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def _values(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all cells of a binary column, and how many each cell has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(data[offs[0] : offs[-1]] if data is not None else b"", dtype)
    return flat, np.diff(offs) // size


def op10_query(docs: DataFrame) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path)
    return read_ids(docs.sparkSession, path)
