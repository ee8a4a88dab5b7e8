"""Secret scans with a trigram inverted index.

From the parse tree of each rule's regular expression comes a Boolean query of
trigrams that every match must hold: literal stretches give conjunctions of
their trigrams, alternatives give disjunctions. For each block of texts an
inverted index lists, for every trigram of the queries, the texts that hold it.
A rule's query intersects and unites these postings, and the expression runs on
the texts that are left. A rule without mandatory trigrams runs on every text.

Trigrams are taken of UTF-8 bytes with A-Z in lower case, which only widens the
candidates. Rules match ASCII letters alone where they ignore case. Matches are
leftmost and do not overlap within a rule; those that fail a rule's least length
are dropped. Positions are code points, ends exclusive.

Defined cases: a null text counts as empty and has no matches. Rows, repeated
ones too, stay as they are. An empty table gives an empty result. No text is
cut; blocks of texts have a bounded size. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarn.llm.common import id_and_text, map_texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1  # characters that the group must have
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The order of the base kinds is that of their listing.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=8, any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
#: Published formats of keys, after the base kinds.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE

#: Sets of literal strings larger than this are cut into trigrams and forgotten.
MOST_STRINGS = 200

#: A query: True (anything), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple


def _both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    return ("and", frozenset({a, b})) if a != b else a


def _either(queries: set[Query]) -> Query:
    if True in queries:
        return True
    return next(iter(queries)) if len(queries) == 1 else ("or", frozenset(queries))


def _of_strings(strings: set[bytes]) -> Query:
    """What a text with one of these strings must hold."""
    found = set()
    for s in strings:
        every = frozenset(s[i : i + 3] for i in range(len(s) - 2))
        found.add(True if not every else next(iter(every)) if len(every) == 1 else ("and", every))
    return _either(found)


def _strings_of_set(items: list) -> set[bytes] | None:
    """The characters of a small class."""
    found = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(value)
        elif op is sre.RANGE:
            found |= set(range(value[0], value[1] + 1))
        else:
            return None
        if len(found) > 8:
            return None
    return {chr(c).encode().lower() for c in found}


def _look(op, value) -> tuple[set[bytes] | None, Query]:
    """The strings that a node matches, if few and known, and what its matches must hold."""
    if op is sre.LITERAL:
        return {chr(value).encode().lower()}, True
    if op is sre.IN:
        return _strings_of_set(value), True
    if op is sre.SUBPATTERN:
        return _sequence(value[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
        return exact, _either({q if s is None else _both(q, _of_strings(s)) for s, q in parts})
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = value
        strings, query = _sequence(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {b""}, True
        if low == high == 1:
            return strings, query
        if not low:
            return None, True
        return None, query if strings is None else _both(query, _of_strings(strings))
    return None, True


def _sequence(nodes) -> tuple[set[bytes] | None, Query]:
    run, query, exact = {b""}, True, True
    for op, value in nodes:
        strings, needs = _look(op, value)
        if strings is None or len(run) * len(strings) > MOST_STRINGS:
            query, run, exact = _both(query, _of_strings(run)), {b""}, False
        if strings is None:
            query = _both(query, needs)
        else:
            run = {a + b for a, b in product(run, strings)}
    return (run, query) if exact else (None, _both(query, _of_strings(run)))


def trigram_query(rule: Rule) -> Query:
    """The trigrams that every match of the rule must hold."""
    strings, query = _sequence(_parser.parse(rule.pattern, re.ASCII))
    return query if strings is None else _both(query, _of_strings(strings))


def trigrams(query: Query) -> set[bytes]:
    if isinstance(query, tuple):
        return set().union(*(trigrams(q) for q in query[1]))
    return set() if query is True else {query}


class Index:
    """The inverted index of a block of texts for the trigrams of some queries."""

    def __init__(self, wanted: list[bytes]):
        self.number = {t: i + 1 for i, t in enumerate(wanted)}
        self.lookup = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.number.items():
            self.lookup[t[0] << 16 | t[1] << 8 | t[2]] = i

    def read(self, texts: list[str]) -> None:
        lines = [t.encode().lower() + b"\0" for t in texts]
        data = np.frombuffer(b"".join(lines) + b"\0\0", dtype=np.uint8).astype(np.uint32)
        found = self.lookup[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(found)
        ends = np.cumsum([len(x) for x in lines])
        self.postings = np.zeros((len(self.number) + 1, len(texts)), dtype=bool)
        self.postings[found[at], np.searchsorted(ends, at, side="right")] = True

    def candidates(self, query: Query) -> np.ndarray:
        """Which texts satisfy a query."""
        if query is True:
            return np.ones(self.postings.shape[1], dtype=bool)
        if isinstance(query, bytes):
            return self.postings[self.number[query]]
        parts = [self.candidates(q) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r)) for r in rules]
        self.index = Index(sorted(set().union(*(trigrams(q) for _, _, q in self.rules))))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end), in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        self.index.read(texts)
        for number, (rule, pattern, query) in enumerate(self.rules):
            for i in np.flatnonzero(self.index.candidates(query)).tolist():
                for m in pattern.finditer(texts[i]):
                    start, end = m.span(rule.group)
                    if end - start >= rule.least:
                        found[i].append((m.start(), number, m.end()))
        return [sorted(x) for x in found]


def secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, found (array of kind, start, end: by start, then in the rules' order)."""
    kinds = [r.kind for r in rules]

    def make():
        scanner = Scanner(rules)

        def work(texts):
            return {
                "found": [
                    [{"kind": kinds[k], "start": a, "end": b} for a, k, b in spans] for spans in scanner.scan(texts)
                ]
            }

        return work

    span = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
    return map_texts(id_and_text(docs, id_col, text_col), [T.StructField("found", T.ArrayType(span))], make)
