"""Fill-in-the-middle over seekable compressed frames.

A text is stored as independent zstandard frames of up to 64 KB, with the number of units, code points
and bytes before each frame. A unit is a run of ASCII letters or one other code point; a run that
crosses a frame's edge counts where it starts. A cut after k units is found by binary search over the
counts, and only the frame that holds it is decompressed. All other frames go into the output as they
are, beside short frames for the marks and the ends of cut frames, so the output is again a
zstandard stream. Digests and the rebuilt text stream over frames in order: whatever the length of a
text, one frame at a time is decompressed.

Rows: a null text is empty, and an empty text is plain; a null doc_id draws like the decimal number
left empty (``1:``); repeated rows give repeated results; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import raw, slices, stored

FRAME_BYTES = 64 << 10
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts so many are rewritten, and of 100 rewritten ones so many put the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20
SEED = 1
#: Columns of a stored text: its frames, and the units, code points and bytes before each (one entry more than frames).
FRAMES = "frames array<binary>, units array<long>, chars array<long>, bytes array<long>, marked boolean"

_LETTER = np.zeros(256, bool)
_LETTER[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True


def unit_starts(data: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the bytes that start a unit and of those that start a code point.

    ``joined``: the byte before ``data`` is a letter, so letters at its beginning belong to an earlier unit.
    """
    lead = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    begin = lead.copy()
    begin[1:] &= ~(letter[1:] & letter[:-1])
    if joined and len(data) and letter[0]:
        begin[0] = False
    return begin, lead


def frame_ends(data: np.ndarray, limit: int) -> list[int]:
    """Ends of the frames of a text: every ``limit`` bytes, moved back to the start of a code point."""
    ends, at = [], 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
        at = end
    return ends


def encode(data: np.ndarray, limit: int = FRAME_BYTES, level: int = LEVEL) -> tuple[list[bytes], list[int], list[int], list[int], bool]:
    """Frames of one text with the counts before each, and whether the text contains a mark."""
    pack = zstandard.ZstdCompressor(level=level)
    frames, units, chars, sizes = [], [0], [0], [0]
    marked, tail = False, b""
    for end in frame_ends(data, limit):
        at = sizes[-1]
        part = data[at:end]
        begin, lead = unit_starts(part, at > 0 and bool(_LETTER[data[at - 1]]))
        content = part.tobytes()
        marked = marked or any(m in tail + content for m in (PREFIX, SUFFIX, MIDDLE))
        tail = content[-2:]
        frames.append(pack.compress(content))
        units.append(units[-1] + int(begin.sum()))
        chars.append(chars[-1] + int(lead.sum()))
        sizes.append(end)
    return frames, units, chars, sizes, marked


def write_frames(docs: DataFrame, *more: Column, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``doc_id``, the columns ``more`` and the frames of every text."""
    rows = docs.select("doc_id", *more, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, offs = raw(batch.column("text"))
            found = [encode(flat[a:b], frame_bytes) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            frames, units, chars, sizes, marked = zip(*found, strict=True)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(frames, pa.list_(pa.binary())), pa.array(units, longs), pa.array(chars, longs), pa.array(sizes, longs), pa.array(marked, pa.bool_())],
                [*batch.schema.names[:-1], "frames", "units", "chars", "bytes", "marked"],
            )

    return rows.mapInArrow(scan, f"{kept}, {FRAMES}")


def read_frame(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def locate(frames: list[bytes], units: list[int], chars: list[int], k: int) -> tuple[int, int, int]:
    """Where unit ``k`` starts: its frame, the byte in it and the code points of the text before it."""
    if k >= units[-1]:
        return len(frames), 0, chars[-1]
    f = int(np.searchsorted(units, k, side="right")) - 1
    data = np.frombuffer(read_frame(frames[f]), np.uint8)
    begin, lead = unit_starts(data, False)
    if int(begin.sum()) != units[f + 1] - units[f]:
        begin[0] = False
    at = int(np.flatnonzero(begin)[k - units[f]])
    return f, at, chars[f] + int(lead[:at].sum())


def cut(frames: list[bytes], start: tuple[int, int], end: tuple[int, int], level: int = LEVEL) -> list[bytes]:
    """Frames of the text between two places (frame, byte); whole frames are taken as they are."""
    pack = zstandard.ZstdCompressor(level=level)
    (f, a), (g, b) = start, end
    if f == g:
        return [pack.compress(read_frame(frames[f])[a:b])] if b > a else []
    out = [frames[f] if a == 0 else pack.compress(read_frame(frames[f])[a:])]
    out += frames[f + 1 : g]
    if b:
        out.append(pack.compress(read_frame(frames[g])[:b]))
    return out


def rewrite(frames: list[bytes], units: list[int], chars: list[int], marked: bool, draws: list[int]) -> tuple[str, int | None, int | None, list[bytes]]:
    """Form, code points of prefix and middle (None if plain), and the output's frames."""
    n = units[-1]
    h1, h2, h3, h4 = draws
    if not frames or marked or h3 % 100 >= REWRITTEN:
        return "plain", None, None, frames
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    f, a, before = locate(frames, units, chars, lo)
    g, b, upto = locate(frames, units, chars, hi)
    prefix, middle, suffix = cut(frames, (0, 0), (f, a)), cut(frames, (f, a), (g, b)), cut(frames, (g, b), (len(frames), 0))
    p, s, m = (zstandard.ZstdCompressor(level=LEVEL).compress(x) for x in (PREFIX, SUFFIX, MIDDLE))
    if h4 % 100 < SUFFIX_FIRST:
        return "spm", before, upto - before, [s, *suffix, p, *prefix, m, *middle]
    return "psm", before, upto - before, [p, *prefix, s, *suffix, m, *middle]


def transform(framed: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of frames written beside four draws ``h``.

    ``output`` is a list of zstandard frames; one after another they are a zstandard file of the output text.
    """
    kept = framed.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = (part.column(c).to_pylist() for c in ("frames", "units", "chars", "marked", "h"))
                units = part.column("units").to_pylist()
                form, prefix, middle, output = zip(*(rewrite(*row) for row in zip(*columns, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([u[-1] for u in units], pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.list_(pa.binary()))],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    used = framed.select("doc_id", "frames", "units", "chars", "marked", "h")
    return used.mapInArrow(scan, f"doc_id {kept}, n long, form string, prefix_chars long, middle_chars long, output array<binary>")


def span(frames: list[bytes], ends: np.ndarray, lo: int, hi: int) -> Iterator[bytes]:
    """The bytes ``lo`` to ``hi`` of a stream of frames, frame by frame. ``ends``: bytes up to each frame's end."""
    f = int(np.searchsorted(ends, lo, side="right"))
    while lo < hi:
        start = int(ends[f - 1]) if f else 0
        yield read_frame(frames[f])[lo - start : hi - start]
        lo, f = int(ends[f]), f + 1


def restore(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text from an output and its form, in order and frame by frame."""
    if form == "plain":
        yield from map(read_frame, frames)
        return
    at, tail, found = 0, b"", {}
    ends = np.zeros(len(frames), np.int64)
    for i, frame in enumerate(frames):
        data = read_frame(frame)
        seen = tail + data
        for mark in (PREFIX, SUFFIX, MIDDLE):
            if mark not in found and (here := seen.find(mark)) >= 0:
                found[mark] = at - len(tail) + here
        at += len(data)
        ends[i] = at
        tail = seen[-2:]
    p, s, m = found[PREFIX], found[SUFFIX], found[MIDDLE]
    prefix, suffix = ((p + 3, m), (s + 3, p)) if form == "spm" else ((p + 3, s), (s + 3, m))
    for lo, hi in (prefix, (m + 3, at), suffix):
        yield from span(frames, ends, lo, hi)


def digest(chunks: Iterator[bytes]) -> str:
    total = hashlib.sha256()
    for chunk in chunks:
        total.update(chunk)
    return total.hexdigest()


def digests(outputs: DataFrame) -> DataFrame:
    """Outputs with ``output_sha256`` and ``restored_sha256`` in place of their frames."""
    kept = [f for f in outputs.schema if f.name != "output"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, rebuilt = [], []
            for frames, form in zip(batch.column("output"), batch.column("form").to_pylist(), strict=True):
                frames = frames.as_py()
                made.append(digest(map(read_frame, frames)))
                rebuilt.append(digest(restore(frames, form)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(made, pa.string()), pa.array(rebuilt, pa.string())], [*(f.name for f in kept), "output_sha256", "restored_sha256"])

    return outputs.mapInArrow(scan, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", output_sha256 string, restored_sha256 string")


def draws(seed: int = SEED) -> Column:
    """Four draws per document: groups of eight hexadecimal digits of the sha256 of seed and doc_id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4))).alias("h")


def fill_middle(docs: DataFrame, seed: int = SEED, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The operator: texts to stored frames, and these to outputs (see ``transform``)."""
    return transform(stored(write_frames(docs, draws(seed), frame_bytes=frame_bytes), "frames"))


def op11_query(docs: DataFrame) -> DataFrame:
    return digests(fill_middle(docs))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hx FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tok,
             ('0x' || hx[1:8])::BIGINT AS h1, ('0x' || hx[9:16])::BIGINT AS h2, ('0x' || hx[17:24])::BIGINT AS h3, ('0x' || hx[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT *, len(tok) AS n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS lo, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS hi,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(tok[1:lo], '') AS pre, array_to_string(tok[lo + 1:hi], '') AS mid, array_to_string(tok[hi + 1:n], '') AS suf FROM k)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
