"""Secret scan by one deterministic automaton for all rules.

A rule is a regular expression over bytes: a head, then one or more bytes of a class (the body). All rules become one
Thompson automaton, made deterministic by subset construction and minimal by refinement, as arrays of transitions. Two
such automata are built from the same rules. `search` may begin anywhere and ends where a rule's head and a body of up to
`_SHORT` bytes (the whole least length where the rule has no head) have been read; one pass of it over the bytes of a block of texts tells which
rules can have a span in which texts. It runs over lanes of 1 KB side by side: each lane first guesses that it begins in
the start state; lanes whose predecessor ended elsewhere run again until none changes, so the pass is exact for texts
of any length. `match` begins at a given byte; followed from the leftmost byte where a rule can begin to the last byte at which it
accepts, it gives the rule's spans: leftmost, longest, non-overlapping, those with too short a body dropped. Spans
come from no other engine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, text_blocks

_KEY = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"


@dataclass(frozen=True)
class Rule:
    """A span is head, then bytes of the class `body`, as many as there are; it counts with `least` of them or more.
    An empty body: the head alone. Heads may use literals, \\xHH, [...], (...|...), ? * + {n}."""

    kind: str
    head: str
    body: str = ""
    least: int = 1

    @property
    def pattern(self) -> str:
        return f"{self.head}{self.body}+" if self.body else self.head

    @property
    def strict(self) -> str:
        return f"{self.head}{self.body}{{{self.least}}}{self.body}*" if self.body else self.head


#: Base kinds first, in the order in which spans of equal start are listed. Whole spans of access have 20 characters or more.
RULES = (
    Rule("assign", _KEY + r"""["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6),
    Rule("access", r"AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
    Rule("forge", r"gh[opsu]_", "[A-Za-z0-9]", 30),
    Rule("chat", r"xox[abpr]-", "[A-Za-z0-9-]", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.]", "[A-Za-z0-9_-]"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
#: Bytes of body that `search` asks for after a head.
_SHORT = 4


class _Nfa:
    """Thompson's construction, straight from the text of a pattern."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, pattern: str, at: int) -> int:
        """Appends the pattern after state `at`; its last state."""
        end, used = self._choice(pattern, 0, at)
        if used < len(pattern):
            raise ValueError(f"cannot read {pattern!r} after {used} characters")
        return end

    def _choice(self, p: str, i: int, at: int) -> tuple[int, int]:
        ends = []
        while True:
            self.empty[at].append(begin := self.state())
            end, i = self._row(p, i, begin)
            ends.append(end)
            if i == len(p) or p[i] != "|":
                break
            i += 1
        out = self.state()
        for e in ends:
            self.empty[e].append(out)
        return out, i

    def _row(self, p: str, i: int, at: int) -> tuple[int, int]:
        while i < len(p) and p[i] not in "|)":
            begin, at, first = i, self._fresh(at), len(self.empty)
            end, i = self._item(p, i, at)
            least, most, i = self._times(p, i)
            if (least, most) != (1, 1):
                # The item is built once for each time it must come, then once more for the times it may.
                del self.empty[first:], self.step[first:]
                self.step[at], self.empty[at] = None, []
                for _ in range(least):
                    at = self._fresh(self._item(p, begin, at)[0])
                loop, out = self._fresh(at), self.state()
                if most is None:
                    self.empty[self._item(p, begin, self._fresh(loop))[0]].append(loop)
                elif most > least:
                    self.empty[self._item(p, begin, self._fresh(loop))[0]].append(out)
                self.empty[loop].append(out)
                end = out
            at = end
        return at, i

    def _fresh(self, at: int) -> int:
        self.empty[at].append(to := self.state())
        return to

    def _item(self, p: str, i: int, at: int) -> tuple[int, int]:
        if p[i] == "(":
            end, i = self._choice(p, i + 1, at)
            return end, i + 1
        if p[i] == "[":
            close = p.index("]", i + 1)
            found, j = set(), i + 1
            while j < close:
                low, j = self._byte(p, j)
                high = low
                if p[j] == "-" and j + 1 < close:
                    high, j = self._byte(p, j + 1)
                found.update(range(low, high + 1))
            i = close + 1
        elif p[i] in "?*+{.^$":
            raise ValueError(f"cannot read {p!r} at {p[i]!r}")
        else:
            value, i = self._byte(p, i)
            found = {value}
        to = self.state()
        self.step[at] = (frozenset(found), to)
        return to, i

    @staticmethod
    def _byte(p: str, i: int) -> tuple[int, int]:
        if p[i : i + 2] == "\\x":
            return int(p[i + 2 : i + 4], 16), i + 4
        if ord(p[i]) > 127 or p[i] == "\\":
            raise ValueError(f"cannot read {p!r} at {p[i]!r}")
        return ord(p[i]), i + 1

    @staticmethod
    def _times(p: str, i: int) -> tuple[int, int | None, int]:
        """(least, most or None, next place) of the count that stands at i, if any."""
        sign = p[i : i + 1]
        if sign in ("?", "*", "+"):
            return int(sign == "+"), 1 if sign == "?" else None, i + 1
        if sign == "{":
            close = p.index("}", i)
            return int(p[i + 1 : close]), int(p[i + 1 : close]), close + 1
        return 1, 1, i


@dataclass(frozen=True)
class Automaton:
    """next[state * n_classes + class of byte] is the next state times n_classes; ends[state] has the bits of the patterns
    that end there, live[state] of those that can still end. State 0 is the start."""

    classes: np.ndarray
    n_classes: int
    next: np.ndarray
    ends: np.ndarray
    live: np.ndarray
    #: The same as lists, for walks of single bytes.
    lists: tuple = field(compare=False, repr=False)


def _minimise(table: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Moore's refinement: states stay together while their ends and their successors' groups agree."""
    _, group = np.unique(ends, return_inverse=True)
    while True:
        _, first, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if len(first) == len(np.unique(group)):
            return finer[table[first]], ends[first], finer[0]
        group = finer


def determinise(patterns: list[tuple[str, int]], anywhere: bool, most_states: int = 200_000) -> Automaton:
    """The minimal automaton of the patterns (text, bit); anywhere: it may begin at every byte."""
    nfa, final = _Nfa(), {}
    root = nfa.state()
    for pattern, bit in patterns:
        final[nfa.add(pattern, nfa._fresh(root))] = bit
    sets = [s[0] for s in nfa.step if s]
    keys: dict[tuple, int] = {}
    classes = np.array([keys.setdefault(tuple(b in s for s in sets), len(keys)) for b in range(256)])
    sample = {int(c): b for b, c in reversed(list(enumerate(classes)))}
    on = [[s[1] if s and sample[c] in s[0] else -1 for c in range(len(keys))] for s in nfa.step]

    @lru_cache(maxsize=None)
    def closure(s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(x for x in seen if nfa.step[x] or x in final)

    start = closure(root)
    always = start if anywhere else frozenset()
    number, order, rows = {start: 0}, [start], []
    for states in order:  # grows as new sets are met
        row = []
        for c in range(len(keys)):
            to = always.union(*(closure(on[s][c]) for s in states if on[s][c] >= 0))
            if to not in number:
                number[to] = len(order)
                order.append(to)
                if len(order) > most_states:
                    raise ValueError("the rules' automaton has too many states")
            row.append(number[to])
        rows.append(row)
    bits = np.zeros(len(order), np.int64)
    for i, states in enumerate(order):
        for s in states:
            bits[i] |= final.get(s, 0)
    table, ends, begin = _minimise(np.array(rows), bits)
    swap = np.arange(len(ends))  # the start state is 0
    swap[[0, begin]] = swap[[begin, 0]]
    table, ends = swap[table[swap]], ends[swap]
    live = ends.copy()
    while not np.array_equal(live, more := live | np.bitwise_or.reduce(live[table], axis=1)):
        live = more
    n = len(keys)
    step = (table * n).astype(np.int32).ravel()
    lists = (step.tolist(), np.repeat(ends, n).tolist(), np.repeat(live, n).tolist(), bytes(classes.astype(np.uint8)))
    return Automaton(classes.astype(np.uint8), n, step, ends, live, lists)


@dataclass(frozen=True)
class Scanner:
    """search: bit k for rule k. match: bit k for rule k's pattern, bit k + len(rules) where the body is long enough.
    begins[k][two bytes]: can rule k begin with them?"""

    rules: tuple[Rule, ...]
    search: Automaton
    match: Automaton
    begins: np.ndarray


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The two minimal automata of the rules; raises where one would have too many states."""
    search = [(f"{r.head}{r.body}{{{min(r.least, _SHORT) if r.head else r.least}}}" if r.body else r.head, 1 << k) for k, r in enumerate(rules)]
    match = determinise([(r.pattern, 1 << k) for k, r in enumerate(rules)] + [(r.strict, 1 << k + len(rules)) for k, r in enumerate(rules)], False)
    n = match.n_classes
    first = match.next[match.classes]
    second = match.next[first[:, None] + match.classes[None, :]]
    after_one, after_two = match.ends[first // n], match.live[second // n]
    begins = np.stack([((after_one[:, None] | after_two) >> k & 1).astype(bool).ravel() for k in range(len(rules))])
    return Scanner(rules, determinise(search, True), match, begins)


def scan(auto: Automaton, data: np.ndarray, offsets: np.ndarray, lane: int = 1024) -> np.ndarray:
    """For each row the bits of the rules that end somewhere in it."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    parts = (lengths + lane - 1) // lane
    row = np.repeat(np.arange(n), parts)
    index = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[:-1][row] + index * lane
    size = np.minimum(offsets[1:][row] - begin, lane)
    order = np.argsort(-size, kind="stable")
    cls = auto.classes[data]
    ends = auto.ends
    entry, leave, met = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32), np.zeros(len(row), np.int64)
    run = order
    while len(run):
        state, hit = entry[run].copy(), np.zeros(len(run), np.int64)
        left, at = size[run], begin[run]
        live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), "right")  # lanes with a byte at each step
        for j, k in enumerate(live):
            state[:k] = auto.next[state[:k] + cls[at[:k] + j]]
            hit[:k] |= ends[state[:k] // auto.n_classes]
        leave[run], met[run] = state, hit
        before = np.where(index > 0, np.roll(leave, 1), 0)
        changed = before != entry
        entry = before
        run = order[changed[order]]
    found = np.zeros(n, np.int64)
    np.bitwise_or.at(found, row, met)
    return found


#: Bytes that a walk may go beyond its last end before it is checked against the walks that found none.
_SURE = 32


def spans_of(text: bytes, bits: int, scanner: Scanner) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points of the spans of the rules that `bits` names, sorted.

    From each place where a rule can begin, the automaton is walked to the last end. Where a walk goes on past _SURE bytes and
    finds no further end, its states and places are kept; a later walk that comes by one of them stops there. So no
    place is walked twice in one state, and time grows with the text's length, whatever it holds."""
    step, ends, live, classes = scanner.match.lists
    width = len(step)
    data, n, many = np.frombuffer(text, np.uint8), len(text), len(scanner.rules)
    pairs = data.astype(np.uint16) << 8
    pairs[:-1] |= data[1:]
    read, found = text.translate(classes), []
    for k in range(many):
        if not bits >> k & 1:
            continue
        own, good, free = 1 << k, 1 << k + many, 0
        vain: set[int] = set()  # place * number of states + state: no end from there on
        # A rule that begins with the last byte alone has no second byte to go by; that byte is always tried.
        for i in np.flatnonzero(scanner.begins[k][pairs[:-1]]).tolist() + [n - 1]:
            if i < free:
                continue
            s, last, passed, sure = 0, -1, False, i + _SURE
            trail: list[int] = []
            for j in range(i, n):
                s = step[s + read[j]]
                if not live[s] & own:
                    break
                if ends[s] & own:
                    last, passed, sure = j + 1, bool(ends[s] & good), j + _SURE
                    if trail:
                        trail.clear()
                elif j >= sure:
                    if (spot := j * width + s) in vain:
                        break
                    trail.append(spot)
            vain.update(trail)
            if last > 0:
                free = last
                if passed:
                    found.append((i, k, last))
    if found and not text.isascii():
        head = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
        found = [(int(head[a]), k, int(head[b])) for a, k, b in found]
    return sorted(found)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: counts of the base kinds, the digest of their spans and all spans.

    A null or empty text has no span: counts 0, spans "". Very long texts run as many lanes. Repeated rows give
    repeated results; a null doc_id stays null; other columns are not read. The table of transitions is sent to the
    tasks; its size depends on the rules alone and is checked where it is built.
    """
    shared = compile_rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        base = {k for k, r in enumerate(rules) if r.kind in BASE}
        place = {r.kind: k for k, r in enumerate(rules)}
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offsets in text_blocks(batch):
                bits = scan(shared.search, data, offsets)
                n = b - a
                counts = {kind: [0] * n for kind in BASE}
                digest, listed, many = [nothing] * n, [""] * n, [0] * n
                for i in np.flatnonzero(bits):
                    found = spans_of(data[offsets[i] : offsets[i + 1]].tobytes(), int(bits[i]), shared)
                    own = [x for x in found if x[1] in base]
                    for kind in BASE:
                        counts[kind][i] = sum(x[1] == place.get(kind) for x in own)
                    show = lambda xs: ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in xs)
                    digest[i], listed[i], many[i] = hashlib.sha256(show(own).encode()).hexdigest(), show(found), len(found)
                columns = [ids.slice(a, n), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digest), pa.array(listed), pa.array(many, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    return id_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def redact(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """df with every span of text_col replaced by mark, overlapping spans by one; other columns and null texts as they are."""
    shared = compile_rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            texts = column.to_pylist()
            only = pa.RecordBatch.from_arrays([column], ["text"])
            for a, _, data, offsets in text_blocks(only):
                bits = scan(shared.search, data, offsets)
                for i in np.flatnonzero(bits):
                    text, parts, at = texts[a + i], [], 0
                    for start, _, end in spans_of(text.encode(), int(bits[i]), shared):
                        if start >= at:
                            parts += [text[at:start], mark]
                        at = max(at, end)
                    texts[a + i] = "".join(parts) + text[at:]
            place = batch.schema.get_field_index(text_col)
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, column.type))

    return df.mapInArrow(run, df.schema)
