"""Secret scans with a trigram inverted index.

Each rule's regular expression is parsed into a Boolean trigram query: sequences join literals, alternatives become OR,
repeats that may be empty drop out.  Documents are indexed in blocks (the index is split by document, so
nothing is shuffled): for the trigrams that any query names, the block's posting lists hold the documents that contain them,
in lower case.  A query's AND and OR intersect and unite posting lists; only candidates are verified with the regular
expression, over the whole text.  Rules without a mandatory trigram scan every document.

Spans are code points, end exclusive.  Null and empty texts hold no span.  Repeated rows give repeated results; an
empty table gives an empty result.  Only the id and text columns are read; other columns don't matter.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks, small_batches, tidy, utf8


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern (ASCII), the group that must have min_length characters, and whether letters match in either case."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0
    either_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


#: The base rules, in the order in which spans with one start are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further public token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z]{3,8}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)

# ---- trigram queries -------------------------------------------------------------------------------------------
# A query is True (any document), a trigram, ("and", ...) or ("or", ...).

MOST_STRINGS = 64


def _and(parts: Iterable) -> object:
    held = {p for p in parts if p is not True}
    return True if not held else next(iter(held)) if len(held) == 1 else ("and", *sorted(held, key=repr))


def _or(parts: Iterable) -> object:
    held = set(parts)
    return True if True in held or not held else next(iter(held)) if len(held) == 1 else ("or", *sorted(held, key=repr))


def _grams(s: str) -> object:
    return _and(s[i : i + 3] for i in range(len(s) - 2))


@dataclass
class _Part:
    """What a piece of a pattern matches: a finite set of strings, or else a query with sets of prefixes and suffixes."""

    exact: frozenset | None
    query: object = True
    prefix: frozenset = field(default_factory=lambda: frozenset([""]))
    suffix: frozenset = field(default_factory=lambda: frozenset([""]))

    def need(self) -> object:
        return _and([self.query, _or(_grams(s) for s in self.exact)]) if self.exact is not None else self.query


_ANY = _Part(None)


def _opened(p: _Part) -> _Part:
    return p if p.exact is None else _Part(None, p.need(), p.exact, p.exact)


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Part(frozenset(x + y for x in a.exact for y in b.exact))
    x, y = _opened(a), _opened(b)
    across = True
    if len(x.suffix) * len(y.prefix) <= MOST_STRINGS:
        across = _or(_grams(s[-2:] + p[:2]) for s in x.suffix for p in y.prefix)
    prefix = frozenset(s + p for s in a.exact for p in y.prefix) if a.exact is not None and len(a.exact) * len(y.prefix) <= MOST_STRINGS else x.prefix
    suffix = frozenset(s + p for s in x.suffix for p in b.exact) if b.exact is not None and len(x.suffix) * len(b.exact) <= MOST_STRINGS else y.suffix
    return _Part(None, _and([x.query, y.query, across]), prefix, suffix)


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_STRINGS:
        return _Part(frozenset().union(*(p.exact for p in parts)))
    held = [_opened(p) for p in parts]
    return _Part(None, _or(p.query for p in held), frozenset().union(*(p.prefix for p in held)), frozenset().union(*(p.suffix for p in held)))


def _part(tree) -> _Part:
    out = _Part(frozenset([""]))
    for op, arg in tree:
        if op is C.LITERAL:
            p = _Part(frozenset([chr(arg).lower()])) if arg < 128 else _ANY
        elif op is C.IN:
            chars: set[str] = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is C.RANGE and x[1] - x[0] < 64:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars |= {chr(c) for c in range(128)}
            p = _Part(frozenset(chars)) if len(chars) <= 8 and all(ord(c) < 128 for c in chars) else _ANY
        elif op is C.SUBPATTERN:
            p = _part(arg[3])
        elif op is C.BRANCH:
            p = _either([_part(x) for x in arg[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            inner = _part(sub)
            if low == 0:
                p = _either([_Part(frozenset([""])), inner]) if high == 1 else _ANY
            else:
                p = functools.reduce(_joined, [inner] * min(low, 8))
                p = p if low == high and low <= 8 else _joined(p, _ANY)
        elif op is C.AT:
            continue
        else:
            p = _ANY
        out = _joined(out, p)
    return out


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every text with a match fulfils, over lower-case text; True if there is none."""
    return _part(_parser.parse(pattern, re.ASCII)).need()


def query_trigrams(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(query_trigrams(q) for q in query[1:]))


class TrigramIndex:
    """Posting lists of a block of documents for the wanted trigrams."""

    def __init__(self, texts: list[bytes], wanted: list[str], marks: np.ndarray):
        self.n = len(texts)
        buf = np.frombuffer(b"\n\n".join(texts).lower() + b"\n\n", dtype=np.uint8).astype(np.uint32)
        code = (buf[:-2] << 16) | (buf[1:-1] << 8) | buf[2:]
        found = marks[code]
        where = np.flatnonzero(found)
        ends = np.cumsum([len(t) + 2 for t in texts])
        pairs = np.unique(found[where].astype(np.int64) * self.n + np.searchsorted(ends, where, side="right"))
        self.postings = {g: pairs[(pairs >= (i + 1) * self.n) & (pairs < (i + 2) * self.n)] - (i + 1) * self.n for i, g in enumerate(wanted)}

    def candidates(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        lists = [self.candidates(q) for q in query[1:]]
        return functools.reduce(np.intersect1d if query[0] == "and" else np.union1d, lists)


def trigram_marks(wanted: list[str]) -> np.ndarray:
    """For each three-byte code the position in wanted plus one, or 0."""
    marks = np.zeros(1 << 24, dtype=np.uint16)
    for i, g in enumerate(wanted):
        a, b, c = g.encode("ascii")
        marks[(a << 16) | (b << 8) | c] = i + 1
    return marks


def spans_of(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; those whose group is too short go, but use up their text."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.min_length]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and spans, an array of (start, end, rule number) by start, then rule."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = [trigram_query(r.pattern) for r in rules]
        wanted = sorted(set().union(*(query_trigrams(q) for q in queries)))
        marks = trigram_marks(wanted)
        compiled = [r.compiled() for r in rules]
        for pdf in batches:
            ids, texts = pdf.iloc[:, 0], pdf.iloc[:, 1].tolist()
            raw = utf8(texts)
            for a, b in chunks(raw):
                index = TrigramIndex(raw[a:b], wanted, marks)
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for i in index.candidates(query):
                        if raw[a + i]:
                            found[i] += [{"start": s, "end": e, "rule": k} for s, e in spans_of(rule, compiled[k], texts[a + i])]
                for x in found:
                    x.sort(key=lambda s: (s["start"], s["rule"], s["end"]))
                yield pd.DataFrame({"id": ids.iloc[a:b].to_numpy(), "spans": found})

    small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = thin.schema["id"].dataType.simpleString()
    return thin.mapInPandas(tidy(scan), f"id {kind}, spans array<struct<start:long,end:long,rule:int>>").withColumnRenamed("id", id_col)


def secrets_report(found: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    kinds = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    base = len(BASE_RULES)
    line = f"array_join(transform({{}}, x -> concat({kinds}[x.rule], ':', x.start, ':', x.end)), ',')"
    count = lambda k: F.expr(f"CAST(size(filter(spans, x -> x.rule = {k})) AS BIGINT)")
    return found.select(
        F.col(id_col),
        *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)),
        F.sha2(F.expr(line.format(f"filter(spans, x -> x.rule < {base})")), 256).alias("base_sha256"),
        F.expr(line.format("spans")).alias("spans"),
    )
