"""Regular expressions to one minimal deterministic automaton, as transition arrays over bytes.

Syntax: literals, ``\\`` escapes (``\\xHH`` too), classes ``[...]`` with ranges and negation, groups,
``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``. Patterns are over bytes. No anchors or look-around.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Fragment:
    start: int
    end: int


@dataclass
class Nfa:
    """Steps by byte set and empty steps; built rule by rule."""

    bytes_: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.bytes_.append([])
        self.empty.append([])
        return len(self.empty) - 1

    def on(self, chars: frozenset[int]) -> Fragment:
        a, b = self.state(), self.state()
        self.bytes_[a].append((chars, b))
        return Fragment(a, b)

    def nothing(self) -> Fragment:
        a = self.state()
        return Fragment(a, a)

    def then(self, parts: list[Fragment]) -> Fragment:
        for x, y in zip(parts, parts[1:], strict=False):
            self.empty[x.end].append(y.start)
        return Fragment(parts[0].start, parts[-1].end) if parts else self.nothing()

    def either(self, parts: list[Fragment]) -> Fragment:
        a, b = self.state(), self.state()
        for p in parts:
            self.empty[a].append(p.start)
            self.empty[p.end].append(b)
        return Fragment(a, b)

    def star(self, part: Fragment) -> Fragment:
        a, b = self.state(), self.state()
        self.empty[a] += [part.start, b]
        self.empty[part.end] += [part.start, b]
        return Fragment(a, b)


class Parser:
    def __init__(self, nfa: Nfa, pattern: str, fold: bool = False) -> None:
        self.nfa, self.text, self.at, self.fold = nfa, pattern, 0, fold

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def chars(self, codes: set[int]) -> frozenset[int]:
        if self.fold:
            codes |= {c ^ 32 for c in codes if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(codes)

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def klass(self) -> frozenset[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        codes: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                codes |= set(range(low, (self.escape() if c == "\\" else ord(c)) + 1))
            else:
                codes.add(low)
        self.take()
        codes = set(self.chars(codes))
        return frozenset(set(range(256)) - codes if negated else codes)

    def atom(self) -> Fragment:
        c = self.take()
        if c == "(":
            inner = self.choice()
            self.take()
            return inner
        if c == "[":
            return self.nfa.on(self.klass())
        return self.nfa.on(self.chars({self.escape() if c == "\\" else ord(c)}))

    def repeat(self) -> Fragment:
        begin = self.at
        part = self.atom()
        end = self.at
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                close = self.text.index("}", self.at)
                low, _, high = self.text[self.at : close].partition(",")
                bounds = int(low), (int(high) if high else None) if "," in self.text[self.at : close] else int(low)
                self.at = close + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            part = self.times(begin, end, *bounds)
            end = self.at
        return part

    def again(self, begin: int, end: int) -> Fragment:
        inner = Parser(self.nfa, self.text[begin:end], self.fold)
        return inner.choice()

    def times(self, begin: int, end: int, low: int, high: int | None) -> Fragment:
        parts = [self.again(begin, end) for _ in range(low)]
        if high is None:
            parts.append(self.nfa.star(self.again(begin, end)))
        else:
            parts += [self.nfa.either([self.again(begin, end), self.nfa.nothing()]) for _ in range(high - low)]
        return self.nfa.then(parts)

    def sequence(self) -> Fragment:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeat())
        return self.nfa.then(parts)

    def choice(self) -> Fragment:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else self.nfa.either(parts)


@dataclass
class Automaton:
    """``step[state * width + kind[byte]]`` is the next state; state 0 is the start. ``accepts`` has a bit per rule."""

    step: np.ndarray
    kind: np.ndarray
    width: int
    accepts: np.ndarray
    dead: int

    def table(self) -> list[list[int]]:
        """Rows of 256 next states, for walks over a few bytes."""
        rows = self.step.reshape(-1, self.width)
        return rows[:, self.kind].tolist()


def _reverse(nfa: Nfa, part: Fragment) -> tuple[Nfa, Fragment]:
    back = Nfa([[] for _ in nfa.empty], [[] for _ in nfa.empty])
    for s in range(len(nfa.empty)):
        for t in nfa.empty[s]:
            back.empty[t].append(s)
        for chars, t in nfa.bytes_[s]:
            back.bytes_[t].append((chars, s))
    return back, Fragment(part.end, part.start)


def compile_rules(patterns: list[tuple[str, bool]], search: bool, backwards: bool = False) -> Automaton:
    """One automaton for all (pattern, fold case) rules: subset construction, then minimisation.

    With ``search`` it accepts after every byte that ends a match begun anywhere, else only from the
    start. ``backwards`` reads matches from their ends.
    """
    nfa = Nfa()
    ends: dict[int, int] = {}
    begin = nfa.state()
    for rule, (pattern, fold) in enumerate(patterns):
        own = Nfa()
        part = Parser(own, pattern, fold).choice()
        if backwards:
            own, part = _reverse(own, part)
        shift = len(nfa.empty)
        nfa.empty += [[t + shift for t in row] for row in own.empty]
        nfa.bytes_ += [[(c, t + shift) for c, t in row] for row in own.bytes_]
        nfa.empty[begin].append(part.start + shift)
        ends[part.end + shift] = rule

    # bytes that no class tells apart share a column
    classes = {chars for row in nfa.bytes_ for chars, _ in row}
    signature = [tuple(b in chars for chars in classes) for b in range(256)]
    columns = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    kind = np.array([columns[s] for s in signature], np.uint8)
    samples = [signature.index(s) for s in columns]

    def close(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    first = close({begin})
    number, rows, todo = {first: 0}, [], [first]
    for subset in todo:
        row = []
        for b in samples:
            goal = close({t for s in subset for chars, t in nfa.bytes_[s] if b in chars} | ({begin} if search else set()))
            if goal not in number:
                number[goal] = len(number)
                todo.append(goal)
            row.append(number[goal])
        rows.append(row)
    step = np.array(rows)
    accepts = np.array([sum({1 << ends[s] for s in subset if s in ends}) for subset in todo], np.int64)

    # refine by (own block, blocks of the successors) until the blocks stay
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    # number the blocks in order of appearance, so that the start is 0
    _, where = np.unique(block, return_index=True)
    order = np.argsort(where)
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    block = new[block]
    keep = np.sort(where)
    step, accepts = block[step[keep]], accepts[keep]
    dead = [s for s in range(len(step)) if not accepts[s] and (step[s] == s).all()]
    return Automaton(step.astype(np.uint32).ravel(), kind, step.shape[1], accepts, dead[0] if dead else -1)
