"""Secret scans through a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams: an OR of
ANDs that every match must satisfy.  Documents are indexed in segments (a few MB
of texts, as an Arrow batch brings them): one pass over a segment's bytes gives a
posting list for each trigram that some rule asks for, the lists are
intersected and united by the rules' queries, and only the candidates left meet
the regular expression.  A rule without mandatory trigrams scans every text.

A segment lives within one task, so nothing is shuffled and no key can be hot.
A null or empty text has no spans; repeated rows give one result each; a null id
stays null; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import append_columns, of_documents


@dataclass(frozen=True)
class Rule:
    """``group`` of a match of ``pattern`` must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = 0

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags | re.ASCII)


#: Fixed values. A run of hex digits is cut by its length in the pattern, which gives the same spans as dropping short runs.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}"),
)
RULES = BASE_RULES + MORE_RULES

#: More alternative strings than this are not followed; the trigrams found so far are used.
MOST_STRINGS = 48
#: A character class with more members ends a run of known characters.
MOST_CLASS = 4

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; {frozenset()} is always true
ALWAYS: Query = frozenset([frozenset()])


def absorbed(terms) -> Query:
    """An AND that another one is part of says nothing more."""
    terms = sorted(set(terms), key=len)
    out: list[frozenset] = []
    for t in terms:
        if not any(o <= t for o in out):
            out.append(t)
    return frozenset(out)


def both(a: Query, b: Query) -> Query:
    joined = absorbed(x | y for x, y in product(a, b))
    return joined if len(joined) <= MOST_STRINGS else a


def _of_strings(strings: set[str]) -> Query:
    return absorbed(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MOST_CLASS:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _walk(nodes) -> tuple[Query, set[str] | None]:
    """What a match needs, and all strings it can be (None: not known)."""
    need, run, exact = ALWAYS, {""}, True

    def ended() -> None:
        nonlocal need, run, exact
        need, run, exact = both(need, _of_strings(run)), {""}, False

    for op, arg in nodes:
        if op is C.LITERAL:
            inner, strings = ALWAYS, {chr(arg).lower()}
        elif op is C.IN:
            inner, strings = ALWAYS, _members(arg)
        elif op is C.SUBPATTERN:
            inner, strings = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            strings = None if any(s is None for _, s in parts) else set().union(*(s for _, s in parts))
            inner = absorbed(t for q, s in parts for t in (q if s is None else _of_strings(s)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner, strings = _walk(body)
            if (low, high) == (0, 1):
                inner, strings = ALWAYS, None if strings is None else strings | {""}
            elif not (low == high == 1):
                inner = ALWAYS if low == 0 else both(inner, _of_strings(strings)) if strings is not None else inner
                strings = None
        elif op is C.AT:
            continue
        else:
            inner, strings = ALWAYS, None
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
        else:
            ended()
            need = both(need, inner if strings is None else _of_strings(strings))
    return (need, run) if exact else (both(need, _of_strings(run)), None)


def trigram_query(rule: Rule) -> Query:
    """What the lower-cased text of any match must hold; ALWAYS if nothing is certain."""
    need, strings = _walk(_parser.parse(rule.pattern, rule.flags))
    return need if strings is None else _of_strings(strings)


def _codes(trigrams) -> dict[str, int]:
    return {t: int.from_bytes(t.encode(), "big") for t in trigrams}


class Segment:
    """Posting lists (positions in ``texts``) of the trigrams asked for."""

    def __init__(self, texts: list[str], slots: np.ndarray, codes: list[int]) -> None:
        self.n = len(texts)
        raw = [t.encode() for t in texts]
        starts = np.cumsum([0] + [len(r) + 2 for r in raw])[:-1]
        a = np.frombuffer(b"\0\0".join(raw).lower(), dtype=np.uint8)  # bytes: only A-Z change
        self.lists: dict[int, np.ndarray] = {}
        if len(a) > 2:
            code = (a[:-2].astype(np.uint32) << 16) | (a[1:-1].astype(np.uint32) << 8) | a[2:]
            slot = slots[code]
            at = np.flatnonzero(slot)
            doc = np.searchsorted(starts, at, side="right") - 1
            pairs = np.unique(slot[at].astype(np.int64) * self.n + doc)
            which, doc = np.divmod(pairs, self.n)
            for k in np.unique(which).tolist():
                self.lists[codes[k - 1]] = doc[which == k]

    def find(self, query: list[list[int]]) -> np.ndarray:
        empty = np.zeros(0, dtype=np.int64)
        hits = [reduce(lambda x, y: np.intersect1d(x, y, assume_unique=True),
                       sorted((self.lists.get(c, empty) for c in term), key=len)) for term in query]
        return reduce(np.union1d, hits, empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (kind, start, end) by start, then order of the rules.

    Positions count code points; the end is exclusive.
    """
    return with_spans(of_documents(docs, doc_id, text), rules).select("doc_id", "spans")


def _finder(rules: tuple[Rule, ...]):
    """A function from texts to their spans (start, number of the rule, end), sorted."""
    queries = [trigram_query(r) for r in rules]
    known = _codes({t for q in queries for term in q for t in term})
    codes = sorted(known.values())
    slots = np.zeros(1 << 24, dtype=np.uint16)
    slots[codes] = np.arange(1, len(codes) + 1)
    asked = [None if q == ALWAYS else [[known[t] for t in term] for term in q] for q in queries]
    regexes = [r.regex for r in rules]

    def find(texts):
        index = Segment(texts, slots, codes)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(zip(rules, regexes, asked)):
            for i in range(len(texts)) if query is None else index.find(query).tolist():
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [sorted(f) for f in found]

    return find


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with its spans in a column ``name``."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def make():
        find = _finder(rules)
        return lambda texts: [[[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in f] for f in find(texts)]]

    return append_columns(docs, [T.StructField(name, T.ArrayType(span))], make, text)


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """Each span, or run of overlapping spans, becomes ``<kind>`` of the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with all spans of its texts replaced; a null text becomes empty."""
    def make():
        find = _finder(rules)
        return lambda texts: [[redact(t, [(a, rules[k].kind, b) for a, k, b in f]) for t, f in zip(texts, find(texts))]]

    return append_columns(docs, [T.StructField(text, T.StringType())], make, text).select(*[F.col(f"`{c}`") for c in docs.columns])
