"""Secret scans with a combined deterministic automaton.

All rules' shortest forms are compiled into one minimal automaton that reads every byte once and
flags where a match may end. A slice of texts is cut into pieces that are read side by side; a piece
whose reading did not begin in the state its predecessor left is read again from that state. Only
flagged places are worked out: the rule's automaton read backwards gives the leftmost start, the
forward one the longest end. Matches are leftmost and do not overlap within a rule.

Rows: a null text is empty; spans are in code points, end exclusive; repeated rows get equal
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.automata import compile_rules
from tidemark.llm.common import raw, slices

PIECE = 512


@dataclass(frozen=True)
class Rule:
    """``trigger`` matches the shortest beginning of a match that ``whole`` extends; ``tail``: the
    least length from the trigger's last byte on, ``least``: the least length in all, else it is dropped."""

    kind: str
    trigger: str
    whole: str
    fold: bool = False
    least: int = 0
    tail: int = 0
    base: bool = True


#: The three base kinds, in the order in which ties are listed; then added kinds.
_NAME = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"
RULES = (
    Rule("assign", _NAME + _VALUE, _NAME + _VALUE + "+", fold=True, tail=6),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]+", least=24),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]", "gh[oprsu]_[A-Za-z0-9]+", least=40, base=False),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.flags = compile_rules([(r.trigger, r.fold) for r in rules], search=True)
        self.back = [compile_rules([(r.trigger, r.fold)], search=False, backwards=True) for r in rules]
        self.ahead = [compile_rules([(r.whole, r.fold)], search=False) for r in rules]
        self.back_rows = [a.table() for a in self.back]
        self.ahead_rows = [a.table() for a in self.ahead]

    def flagged(self, flat: np.ndarray) -> np.ndarray:
        """Rules (bits) that may end after each byte."""
        n = len(flat)
        a = self.flags
        rows = -(-n // PIECE)
        kinds = np.zeros(rows * PIECE, np.uint32)
        kinds[:n] = a.kind[flat]
        kinds = np.ascontiguousarray(kinds.reshape(rows, PIECE).T)
        states = np.zeros((PIECE, rows), np.uint16)
        came = np.zeros(rows, np.uint32)
        todo = np.arange(rows)
        while len(todo):
            now = came[todo]
            whole = len(todo) == rows
            for k in range(PIECE):
                now = a.step[now * np.uint32(a.width) + (kinds[k] if whole else kinds[k][todo])]
                if whole:
                    states[k] = now
                else:
                    states[k, todo] = now
            left = np.zeros(rows, np.uint32)
            left[1:] = states[-1, :-1]
            todo = np.flatnonzero(left != came)
            came = left
        accepts = a.accepts.astype(np.uint8)
        return np.ascontiguousarray(accepts[states].T).ravel()[:n]

    def spans(self, text: bytes, k: int, ends: list[int]) -> list[tuple[int, int]]:
        """Kept matches of rule ``k`` in a text, given where its trigger ends."""
        rule, back, ahead = self.rules[k], self.back_rows[k], self.ahead_rows[k]
        back_ok, ahead_ok = self.back[k].accepts, self.ahead[k].accepts
        back_dead, ahead_dead = self.back[k].dead, self.ahead[k].dead
        out, free = [], 0
        for end in ends:
            if end <= free:
                continue
            state, start = 0, -1
            for i in range(end - 1, free - 1, -1):
                state = back[state][text[i]]
                if state == back_dead:
                    break
                if back_ok[state]:
                    start = i
            if start < 0:
                continue
            state, stop = 0, end
            for i in range(start, len(text)):
                state = ahead[state][text[i]]
                if state == ahead_dead:
                    break
                if ahead_ok[state]:
                    stop = i + 1
            if stop - start >= rule.least and stop - end + 1 >= rule.tail:
                out.append((start, stop))
            free = stop
        return out


def _listed(found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in sorted(found))


def scan_texts(flat: np.ndarray, offs: np.ndarray, scanner: Scanner) -> list[list[tuple[int, int, int]]]:
    """Per text: (start, rule, end) in code points."""
    # a zero byte between texts: no rule reads over it
    n = len(offs) - 1
    spaced = np.zeros(len(flat) + n, np.uint8)
    move = np.repeat(np.arange(n), np.diff(offs))
    spaced[np.arange(len(flat)) + move] = flat
    begin = offs[:-1] + np.arange(n)
    flags = scanner.flagged(spaced)
    at = np.flatnonzero(flags)
    row = np.searchsorted(begin, at, side="right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    cut = np.flatnonzero(np.diff(row)) + 1
    for places in np.split(at, cut) if len(at) else []:
        r = int(np.searchsorted(begin, places[0], side="right")) - 1
        text = flat[offs[r] : offs[r + 1]]
        own = flags[places]
        lead = (text & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(lead)])
        for k in range(len(scanner.rules)):
            ends = (places[(own >> k) & 1 == 1] - begin[r] + 1).tolist()
            if ends:
                out[r] += [(int(points[s]), k, int(points[e])) for s, e in scanner.spans(text.tobytes(), k, ends)]
    return out


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``n_<kind>`` of the base kinds, ``base_sha256`` and ``spans`` of every row."""
    scanner = Scanner(rules)
    base = [k for k, r in enumerate(rules) if r.base]
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{rules[k].kind}" for k in base), "base_sha256", "spans"]

    def scan(batches):
        for batch in slices(batches):
            found = scan_texts(*raw(batch.column("text")), scanner)
            counts = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in base]
            digests = pa.array([hashlib.sha256(_listed([x for x in f if x[1] in base], rules).encode()).hexdigest() for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([_listed(f, rules) for f in found], pa.string())], names)

    longs = ", ".join(f"n_{rules[k].kind} long" for k in base)
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {longs}, base_sha256 string, spans string")
