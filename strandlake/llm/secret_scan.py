"""Secrets by one deterministic automaton for all rules.

Rules are written as small syntax trees over byte sets. Each becomes a nondeterministic automaton; subset construction of their union,
with a loop on the start, gives one deterministic automaton that says at each byte which rules have a match that ends there; partition
refinement makes it minimal, and bytes that no rule tells apart share a column of the flat transition array. A document is scanned in one
pass over its bytes. Where a run of endings closes, the automaton of the rule's mirror image is walked back to the leftmost start.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import with_arrow_columns

# --- syntax trees: ("set", frozenset of bytes), ("cat", [..]), ("alt", [..]), ("star", x)


def chars(spec: str) -> tuple:
    """A set such as "a-z0-9_": ranges and single characters; a dash comes last."""
    out: set[int] = set()
    i = 0
    while i < len(spec):
        if i + 2 < len(spec) and spec[i + 1] == "-":
            out |= set(range(ord(spec[i]), ord(spec[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(spec[i]))
            i += 1
    return ("set", frozenset(out))


def word(text: str, either_case: bool = False) -> tuple:
    return ("cat", [("set", frozenset({ord(c.lower()), ord(c.upper())} if either_case else {ord(c)})) for c in text])


def cat(*x: tuple) -> tuple:
    return ("cat", list(x))


def alt(*x: tuple) -> tuple:
    return ("alt", list(x))


def star(x: tuple) -> tuple:
    return ("star", x)


def opt(x: tuple) -> tuple:
    return ("alt", [x, ("cat", [])])


def many(x: tuple, least: int) -> tuple:
    """least or more."""
    return ("cat", [x] * least + [star(x)])


def mirror(x: tuple) -> tuple:
    kind, arg = x
    if kind == "set":
        return x
    if kind == "star":
        return ("star", mirror(arg))
    return (kind, [mirror(y) for y in (reversed(arg) if kind == "cat" else arg)])


@dataclass(frozen=True)
class Rule:
    name: str
    tree: tuple
    #: Whether a match (as text) counts; matches that don't still cover their text.
    check: object = None


_KEYS = alt(word("password", True), word("passwd", True), word("secret", True), word("token", True), cat(word("api", True), opt(chars("_")), word("key", True)))
_QUOTE = opt(chars("\"'"))
_VALUE = chars("A-Za-z0-9+/_.=-")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def _long_value(match: str) -> bool:
    m = _ASSIGN.fullmatch(match)
    return m is not None and len(m[1]) >= 12


def _at_least(n: int):
    return lambda match: len(match) >= n


def _signed(match: str) -> bool:
    return all(len(p) >= 10 for p in match.split("."))


#: The base rules, in the order of the results, and further ones. A least length is a check after the scan, but for hex: endings of runs as
#: short as words are everywhere, so its length is part of the automaton (a run that is too short covers no other match).
RULES = (
    Rule("assign", cat(_KEYS, _QUOTE, star(chars(" ")), chars(":="), star(chars(" ")), _QUOTE, many(_VALUE, 1)), _long_value),
    Rule("access", cat(word("AKIA"), many(chars("A-Z0-9"), 1)), _at_least(18)),
    Rule("hex", many(chars("0-9a-f"), 16)),
    Rule("hosting", cat(word("gh"), chars("pousr"), word("_"), many(chars("A-Za-z0-9"), 1)), _at_least(40)),
    Rule("chat", cat(word("xox"), chars("abprs"), word("-"), many(chars("A-Za-z0-9-"), 1)), _at_least(15)),
    Rule("signed", cat(word("eyJ"), many(chars("A-Za-z0-9_-"), 1), word(".eyJ"), many(chars("A-Za-z0-9_-"), 1), word("."), many(chars("A-Za-z0-9_-"), 1)), _signed),
    Rule("private_key", cat(word("-----BEGIN "), star(chars("A-Z ")), word("PRIVATE KEY-----"))),
)
BASE = ("assign", "access", "hex")


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: tuple, a: int, b: int) -> None:
        """Paths from a to b that spell tree."""
        kind, arg = tree
        if kind == "set":
            self.moves[a].append((arg, b))
        elif kind == "alt":
            for x in arg:
                self.add(x, a, b)
        elif kind == "star":
            mid = self.state()
            self.empty[a].append(mid)
            self.add(arg, mid, mid)
            self.empty[mid].append(b)
        else:
            for x in arg[:-1]:
                mid = self.state()
                self.add(x, a, mid)
                a = mid
            if arg:
                self.add(arg[-1], a, b)
            else:
                self.empty[a].append(b)


@dataclass(frozen=True)
class Automaton:
    """State s reads byte b: table[s * width + column[b]]; accepts[s] has the rules that end there. State 0 is the start."""

    table: tuple
    column: bytes
    width: int
    accepts: tuple
    #: dead[s]: no match can follow any more (for walks back).
    dead: tuple


def compile_rules(trees: list[tuple], search: bool) -> Automaton:
    """The minimal automaton of all trees; with search, matches may start anywhere."""
    nfa = _Nfa()
    start = nfa.state()
    finals = {}
    for i, tree in enumerate(trees):
        end = nfa.state()
        finals[end] = i
        first = nfa.state()
        nfa.empty[start].append(first)
        nfa.add(tree, first, end)
    # bytes in the same sets throughout share a column
    sets = list({s for moves in nfa.moves for s, _ in moves})
    kinds: dict[tuple, int] = {}
    column = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = [column.index(k) for k in range(len(kinds))]

    def closure(states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)

    begin = closure({start})
    # what each state reaches by each column, closed over empty moves
    reach = [[closure({t for byte_set, t in nfa.moves[s] if b in byte_set}) if nfa.moves[s] else frozenset() for b in sample] for s in range(len(nfa.moves))]
    always = begin if search else frozenset()
    number, order, rows = {begin: 0}, [begin], []
    for now in order:
        row = []
        moving = [reach[s] for s in now if nfa.moves[s]]
        for k in range(len(sample)):
            to = always.union(*(r[k] for r in moving))
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    accepts = [tuple(sorted(finals[s] for s in now if s in finals)) for now in order]
    # minimisation: split classes of states until equal states go to equal classes
    block = [list(dict.fromkeys(accepts)).index(a) for a in accepts]
    while True:
        signature = [(block[s], *(block[t] for t in rows[s])) for s in range(len(rows))]
        names = {x: i for i, x in enumerate(dict.fromkeys(signature))}
        after = [names[x] for x in signature]
        if len(names) == len(set(block)):
            break
        block = after
    first = {}
    for s, c in enumerate(block):
        first.setdefault(c, s)
    renumber = {c: i for i, c in enumerate(first)}  # the start's class comes first
    picked = list(first.values())
    table = [renumber[block[t]] for s in picked for t in rows[s]]
    accepted = tuple(accepts[s] for s in picked)
    n, width = len(picked), len(sample)
    alive = {s for s in range(n) if accepted[s]}
    while True:
        more = {s for s in range(n) if s not in alive and any(t in alive for t in table[s * width : (s + 1) * width])}
        if not more:
            break
        alive |= more
    return Automaton(tuple(table), column, width, accepted, tuple(s not in alive for s in range(n)))


class Scanner:
    """Compiled rules; the transition arrays are one list of rows for each state, with the rules that end there as a row's last element."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.auto = compile_rules([r.tree for r in rules], True)
        self.back = [compile_rules([mirror(r.tree)], False) for r in rules]
        self.first_row: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"first_row": None}  # rows refer to each other; each worker builds its own

    def _rows(self) -> list:
        if self.first_row is None:
            w, n = self.auto.width, len(self.auto.accepts)
            rows: list[list] = [[] for _ in range(n)]
            for s, row in enumerate(rows):
                row += [rows[t] for t in self.auto.table[s * w : (s + 1) * w]]
                row.append(self.auto.accepts[s])
            self.first_row = rows[0]
        return self.first_row

    def _leftmost(self, rule: int, data: bytes, end: int, low: int) -> int:
        """Start, not below low, of the longest match that ends at end; -1 if there is none."""
        auto, s, best = self.back[rule], 0, -1
        table, column, w = auto.table, auto.column, auto.width
        for i in range(end - 1, low - 1, -1):
            s = table[s * w + column[data[i]]]
            if auto.accepts[s]:
                best = i
            elif auto.dead[s]:
                break
        return best

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) in code points, by start, then rule: for each rule leftmost, non-overlapping matches that pass its check."""
        data = text.encode("utf-8", "surrogatepass")
        ends: list[tuple[int, int]] = []  # (rule, end) where a run of endings closes
        row, w = self._rows(), self.auto.width
        last: tuple = ()
        at = 0
        for c in data.translate(self.auto.column):
            row = row[c]
            if row[w] or last:
                for r in last:
                    if r not in row[w]:
                        ends.append((r, at))
                last = row[w]
            at += 1
        ends += [(r, at) for r in last]
        found, low = [], [0] * len(self.rules)
        for r, end in sorted(ends, key=lambda x: x[1]):
            start = self._leftmost(r, data, end, low[r])
            if start < 0:
                continue
            low[r] = end
            check = self.rules[r].check
            if check is None or check(data[start:end].decode()):
                found.append((start, end, r))
        if not found:
            return []
        found.sort(key=lambda x: (x[0], x[2]))
        if not text.isascii():
            marks = sorted({p for f in found for p in f[:2]})
            place, done, n = {}, 0, 0
            for p in marks:
                n += len(data[done:p].decode("utf-8", "surrogatepass"))
                place[p], done = n, p
            found = [(place[a], place[b], r) for a, b, r in found]
        return found


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    return ",".join(f"{rules[r].name}:{a}:{b}" for a, b, r in spans)


FIELDS = [T.StructField("secret_spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with secret_spans (kind, start, end in code points) by start, then rule.

    Null and empty texts have none. Repeated rows have equal results. Texts are scanned whole, in time that grows with their length. An empty table gives no rows. A column of docs with that
    name is replaced.
    """

    s = scanner()  # compiled once, on the driver

    def make():
        return lambda texts: [[[{"kind": s.rules[r].name, "start": a, "end": b} for a, b, r in s.spans(t)] if t else [] for t in texts]]

    return with_arrow_columns(docs, text, FIELDS, make)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query, from secret_spans."""

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def of(kind):
        return F.size(F.filter("secret_spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secret_spans", lambda x: x.kind.isin(*BASE))
    return docs.select("doc_id", *map(of, BASE), F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"), text_of(F.col("secret_spans")).alias("spans"))
