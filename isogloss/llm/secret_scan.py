"""Secret scans (operator 1): all rules in one deterministic automaton, one pass over a text's bytes.

Rule expressions are parsed into Thompson automata. The subset construction keeps, for each rule, its threads in
order of preference, so that a match is the leftmost one and as long as the expression's greedy loops make it, and
the search for the next starts where it ended. A state of the combined automaton is the tuple of all rules' thread
lists; Moore's refinement merges equivalent states, and the result is one array of transitions over classes of
bytes. A match's start comes from the rule's reversed automaton, run back from its end.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .arrow_text import map_texts

_parser = re._parser  # type: ignore[attr-defined]


@dataclass(frozen=True)
class Rule:
    """expression: over bytes. least: the bytes at a match's end that must each complete a match (the length of
    its last loop); shorter matches are consumed, then dropped. base: counted among the base kinds."""

    kind: str
    expression: str
    least: int = 1
    base: bool = False


def either_case(text: str) -> str:
    """The expression with each letter outside brackets and escapes in either case."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
            c += text[i] + (text[i + 1 : i + 3] if text[i] == "x" else "")
            i += 2 * (text[i] == "x")
        elif c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif c.isalpha() and not inside:
            c = f"[{c.upper()}{c.lower()}]"
        out.append(c)
        i += 1
    return "".join(out)


#: The base kinds, in their order, then further kinds of public credential formats.
RULES = (
    Rule("assign", either_case(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""") + r"[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 14, True),
    Rule("hex", r"[0-9a-f]{16,}", 1, True),  # the runs of 16 or more are the matches of [0-9a-f]+ that are kept
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)


class Nfa:
    """Thompson automaton of one expression. moves[s]: (set of bytes, next) or a list of next states without input."""

    def __init__(self, expression: str) -> None:
        self.moves: list[tuple[frozenset[int], int] | list[int]] = []
        self.end = self._state([])
        self.start = self._build(list(_parser.parse(expression.encode("latin-1"))), self.end)

    def _state(self, move: tuple[frozenset[int], int] | list[int]) -> int:
        self.moves.append(move)
        return len(self.moves) - 1

    def _build(self, items: list, after: int) -> int:
        for op, value in reversed(items):
            after = self._one(str(op), value, after)
        return after

    def _one(self, op: str, value, after: int) -> int:
        if op == "LITERAL":
            return self._state((frozenset([value]), after))
        if op == "NOT_LITERAL":
            return self._state((frozenset(range(256)) - {value}, after))
        if op == "ANY":
            return self._state((frozenset(range(256)) - {10}, after))
        if op == "IN":
            return self._state((self._members(value), after))
        if op == "SUBPATTERN":
            return self._build(list(value[-1]), after)
        if op == "BRANCH":
            return self._state([self._build(list(x), after) for x in value[1]])
        if op == "MAX_REPEAT":
            low, high, body = value
            if str(high) == "MAXREPEAT":
                loop = self._state([])
                self.moves[loop] = [self._build(list(body), loop), after]
                after = loop
            else:
                for _ in range(high - low):
                    after = self._state([self._build(list(body), after), after])
            for _ in range(low):
                after = self._build(list(body), after)
            return after
        raise ValueError(f"not supported in a rule: {op}")

    @staticmethod
    def _members(items: list) -> frozenset[int]:
        out: set[int] = set()
        negated = False
        for op, value in items:
            if str(op) == "NEGATE":
                negated = True
            elif str(op) == "LITERAL":
                out.add(value)
            elif str(op) == "RANGE":
                out.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {op}")
        return frozenset(range(256)) - out if negated else frozenset(out)

    def closure(self, states: Sequence[int]) -> tuple[int, ...]:
        """Byte-consuming states and the end that can be reached without input, preferred ones first; what is
        less preferred than the end is cut off."""
        out: list[int] = []
        seen: set[int] = set()
        stack = list(reversed(states))
        while stack:
            s = stack.pop()
            if s in seen:
                continue
            seen.add(s)
            if s == self.end:
                return (*out, s)
            move = self.moves[s]
            if isinstance(move, list):
                stack.extend(reversed(move))
            else:
                out.append(s)
        return tuple(out)


class Forward:
    """Leftmost search of one rule as a deterministic automaton, made state by state."""

    def __init__(self, rule: Rule) -> None:
        self.rule, self.nfa = rule, Nfa(rule.expression)
        self.first = self.nfa.closure([self.nfa.start])
        if self.nfa.end in self.first:
            raise ValueError(f"{rule.kind} matches the empty string")

    def accepts(self, threads: tuple[int, ...]) -> bool:
        return threads[-1:] == (self.nfa.end,)

    def step(self, threads: tuple[int, ...], byte: int) -> tuple[int, ...]:
        moves = self.nfa.moves
        alive = [m[1] for s in threads if s != self.nfa.end and byte in (m := moves[s])[0]]
        matched = self.accepts(threads)
        if matched and alive:
            out = self.nfa.closure(alive)
            if not self.accepts(out):
                raise ValueError(f"{self.rule.kind}: a match must grow byte by byte")
            return out
        if matched:  # the match is over; this byte begins the next search
            return self.step(self.first, byte) if threads != self.first else self.first
        return self.nfa.closure([*alive, self.nfa.start])


class Backward:
    """The reversed automaton of one rule: how far back from a match's end the leftmost start lies."""

    def __init__(self, rule: Rule) -> None:
        nfa = Nfa(rule.expression)
        self.start = nfa.start
        self.into: dict[int, list[tuple[frozenset[int] | None, int]]] = {}
        for s, move in enumerate(nfa.moves):
            for t in move if isinstance(move, list) else [move[1]]:
                self.into.setdefault(t, []).append((None if isinstance(move, list) else move[0], s))
        self.first = self._closure({nfa.end})
        self.known: dict[tuple[frozenset[int], int], frozenset[int]] = {}

    def _closure(self, states: set[int]) -> frozenset[int]:
        stack, out = list(states), set(states)
        while stack:
            for byte, s in self.into.get(stack.pop(), ()):
                if byte is None and s not in out:
                    out.add(s)
                    stack.append(s)
        return frozenset(out)

    def find(self, data: bytes, end: int, least: int) -> int:
        states, i, best = self.first, end, end
        while i > least and states:
            i -= 1
            key = (states, data[i])
            if key not in self.known:
                self.known[key] = self._closure({s for t in states for byte, s in self.into.get(t, ()) if byte is not None and data[i] in byte})
            states = self.known[key]
            if self.start in states:
                best = i
        return best


@dataclass(frozen=True)
class Automaton:
    """classes[byte]: class of the byte. moves[state, class]: next state. marks[state]: bit r is set where rule r
    has a match that ends here. State 0 begins."""

    rules: tuple[Rule, ...]
    classes: bytes
    moves: np.ndarray
    marks: np.ndarray


def compile_rules(rules: Sequence[Rule] = RULES, most: int = 200_000) -> Automaton:
    """The minimal automaton of all rules. Its size depends on the rules alone; over `most` states is an error."""
    forward = [Forward(r) for r in rules]
    sets = {m[0] for f in forward for m in f.nfa.moves if isinstance(m, tuple)}
    kinds: dict[tuple[bool, ...], int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    member = [classes.index(k) for k in range(len(kinds))]
    ids: list[dict[tuple[int, ...], int]] = [{f.first: 0} for f in forward]
    steps: list[dict[tuple[int, int], int]] = [{} for _ in forward]
    lists: list[list[tuple[int, ...]]] = [[f.first] for f in forward]
    first = (0,) * len(forward)
    number, todo, rows = {first: 0}, [first], []
    for state in todo:
        row = []
        for k, byte in enumerate(member):
            to = []
            for r, f in enumerate(forward):
                key = (state[r], k)
                if key not in steps[r]:
                    threads = f.step(lists[r][state[r]], byte)
                    if threads not in ids[r]:
                        ids[r][threads] = len(lists[r])
                        lists[r].append(threads)
                    steps[r][key] = ids[r][threads]
                to.append(steps[r][key])
            at = tuple(to)
            if at not in number:
                number[at] = len(todo)
                todo.append(at)
                if len(todo) > most:
                    raise ValueError("the rules need too many states")
            row.append(number[at])
        rows.append(row)
    moves = np.array(rows, np.int32)
    marks = np.array([sum(1 << r for r, f in enumerate(forward) if f.accepts(lists[r][s[r]])) for s in todo], np.int64)
    block = np.unique(marks, return_inverse=True)[1]
    count = 0
    while block.max() + 1 != count:  # Moore: split blocks until successors agree
        count = block.max() + 1
        block = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].ravel()
    lead = np.full(count, -1)
    lead[block[::-1]] = np.arange(len(block))[::-1]
    order = np.argsort(lead)  # the block of state 0 comes first
    rank = np.argsort(order)
    return Automaton(tuple(rules), classes, rank[block[moves[lead[order]]]].astype(np.int32), marks[lead[order]])


class Scanner:
    """An automaton's arrays as linked rows, which Python follows fastest."""

    def __init__(self, automaton: Automaton) -> None:
        self.rules, self.classes = automaton.rules, automaton.classes
        width = automaton.moves.shape[1]
        self.rows: list[list] = [[None] * (width + 1) for _ in automaton.moves]
        for row, to, mark in zip(self.rows, automaton.moves.tolist(), automaton.marks.tolist(), strict=True):
            row[:width] = [self.rows[t] for t in to]
            row[width] = mark
        self.mark = width
        self.back = [Backward(r) for r in self.rules]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches in bytes, by start, then rule."""
        found: list[tuple[int, int, int]] = []
        opened, ended = [0] * len(self.rules), [0] * len(self.rules)
        row, mark, last = self.rows[0], self.mark, 0

        def change(at: int, now: int, last: int) -> None:
            for r in range(len(self.rules)):
                bit = 1 << r
                if now & bit and not last & bit:
                    opened[r] = at
                elif last & bit and not now & bit:
                    start = self.back[r].find(data, at, ended[r])
                    ended[r] = at
                    if at - opened[r] >= self.rules[r].least:
                        found.append((start, r, at))

        for at, c in enumerate(data.translate(self.classes)):
            row = row[c]
            if row[mark] != last:
                change(at, row[mark], last)
                last = row[mark]
        change(len(data), 0, last)
        return sorted(found)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if not spans or data.isascii():
        return spans
    starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])
    return [(int(before[s]), r, int(before[e])) for s, r, e in spans]


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(compile_rules(rules))


SCHEMA = "doc_id long, found array<struct<kind:string,start:long,end:long>>"


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans found in the whole text (code points, end exclusive), by start, then the rules' order.

    A null or empty text has no spans; repeated rows give repeated results; a null id stays null; an empty table
    gives an empty result; other columns are not read. The automaton is compiled on the driver; its arrays, whose
    size depends on the rules alone, go to the tasks.
    """
    automaton = compile_rules(rules)
    holder: list[Scanner] = []

    def batch(ids: list, texts: list) -> dict[str, list]:
        if not holder:
            holder.append(Scanner(automaton))
        scanner, found = holder[0], []
        for data in texts:
            spans = code_points(data, scanner.scan(data)) if data else []
            found.append([{"kind": scanner.rules[r].kind, "start": s, "end": e} for s, r, e in spans])
        return {"doc_id": ids, "found": found}

    return map_texts(docs, batch, SCHEMA, id_col, text_col)


def redact(texts: list[bytes | None], scanner: Scanner, mark: bytes = b"[secret]") -> list[bytes | None]:
    """The texts with each maximal stretch of spans replaced by the mark."""
    out: list[bytes | None] = []
    for data in texts:
        spans = scanner.scan(data) if data else []
        if not spans:
            out.append(data)
            continue
        parts, at, i = [], 0, 0
        while i < len(spans):
            start, end = spans[i][0], spans[i][2]
            while i + 1 < len(spans) and spans[i + 1][0] <= end:
                i += 1
                end = max(end, spans[i][2])
            parts += [data[at:start], mark]
            at, i = end, i + 1
        out.append(b"".join([*parts, data[at:]]))
    return out

