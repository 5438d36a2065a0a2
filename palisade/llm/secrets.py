"""Secret scans through a trigram inverted index.

For every rule a Boolean query over trigrams is derived from the parse tree of its regular expression (after Cox, 2012):
any text that the rule matches satisfies the query. One pass over the bytes of a batch of documents, with A-Z folded,
builds its inverted index: postings, from each trigram that a query names to the documents that hold it. Queries
intersect postings, the rarest first, and unite them, and only the candidates are verified by the expression itself.
Rules without mandatory trigrams scan every text. As the index is partitioned by documents, no posting list grows with
the input, and no shuffle is needed. No rule takes more than linear time in the length of a text.

Defined cases: a null or empty text has no spans; repeated rows get equal spans; ties in start follow the order of the
rules. Matches of one rule are leftmost and don't overlap; a match that fails its length is dropped. Positions are code
points. Other columns pass through, but for one that is named like the output.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import by_value

by_value(__name__)
parser, codes = re._parser, re._constants
FLAGS = re.ASCII


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters that `group` needs
    group: int = 0
    any_case: bool = False
    base: bool = False


#: The base rules, then those that this method adds. Formats of the keys are those that their issuers publish.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]+", 24, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
STRETCH = 1 << 20  # bytes that are looked at together
WIDEST = 64  # strings that a part of an expression may stand for before it counts as anything

#: A query is True (no condition), a trigram, ("and", queries) or ("or", queries).


def _both(kind: str, queries) -> object:
    flat = {x for q in queries for x in (q[1] if isinstance(q, tuple) and q[0] == kind else [q])}
    if kind == "or" and True in flat:
        return True
    flat -= {True}
    if kind == "or":  # a part that asks for all that another asks for, and more, adds nothing
        asks = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset({q}) for q in flat}
        flat = {q for q in flat if not any(asks[x] < asks[q] for x in flat)}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _grams(strings) -> object:
    """Query for texts that hold one of the strings."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _sequence(items) -> tuple[set[str] | None, object]:
    """(strings that the items stand for, or None for anything; query)."""
    run, exact, query = {""}, True, True

    def flush(run, query):
        return _both("and", [query, _grams(run)]) if run else query

    for op, arg in items:
        some, q = _one(op, arg)
        query = _both("and", [query, q])
        if some is not None and len(run) * len(some) <= WIDEST:
            run = {a + b for a, b in product(run, some)}
        else:
            query = flush(run, query)
            exact = False
            run = some if some is not None else {""}
    return (run, query) if exact else (None, flush(run, query))


def _one(op, arg) -> tuple[set[str] | None, object]:
    fold = lambda c: c.lower() if "A" <= c <= "Z" else c
    if op is codes.LITERAL:
        return {fold(chr(arg))}, True
    if op is codes.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is codes.LITERAL:
                chars.add(fold(chr(x)))
            elif kind is codes.RANGE and x[1] - x[0] < WIDEST:
                chars |= {fold(chr(c)) for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is codes.SUBPATTERN:
        return _sequence(arg[3])
    if op is codes.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= WIDEST:
            return set().union(*(s for s, _ in parts)), _both("or", [q for _, q in parts])
        return None, _both("or", [_both("and", [q, _grams(s)]) if s is not None else q for s, q in parts])
    if op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
        least, most, body = arg
        some, q = _sequence(body)
        if (least, most) == (0, 1) and some is not None:
            return some | {""}, True
        if least == 0:
            return None, True
        if some is not None and least == most and len(some) ** least <= WIDEST:
            return {"".join(x) for x in product(some, repeat=least)}, q
        return None, _both("and", [q, _grams(some)]) if some is not None else q
    if op in (codes.AT, codes.ASSERT, codes.ASSERT_NOT):  # takes no characters
        return {""}, True
    return None, True


def trigrams(pattern: str) -> object:
    """The query of a pattern; True if it has no mandatory trigrams. It holds for folded texts, whatever the case."""
    some, query = _sequence(parser.parse(pattern))
    return _both("and", [query, _grams(some)]) if some is not None else query


def _names(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_names, query[1]))


class Grams:
    """The trigrams that queries name, numbered; `number` holds that of each of the 2^24 byte triples, 0 for all others."""

    def __init__(self, names: set[str]) -> None:
        self.names = sorted(names)
        self.number = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(self.names, 1):
            self.number[int.from_bytes(g.encode(), "big")] = i


class Index:
    """Inverted index of a batch: trigram to the sorted numbers of the texts that hold it, from one pass over the bytes."""

    def __init__(self, texts: list[str], grams: Grams) -> None:
        parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        ends, data = np.cumsum([len(p) + 2 for p in parts]), np.frombuffer(b"\0\0".join(parts), np.uint8)
        self.size, met = len(texts), [np.empty(0, np.int64)]
        for at in range(0, len(data) - 2, STRETCH):
            x = data[at : at + STRETCH + 2].astype(np.int32)
            number = grams.number[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
            hit = np.nonzero(number)[0]
            met.append(np.unique(number[hit].astype(np.int64) * self.size + np.searchsorted(ends, hit + at, "right")))
        pairs = np.unique(np.concatenate(met))
        bounds = np.searchsorted(pairs, np.arange(1, len(grams.names) + 2) * self.size)
        self.postings = {g: pairs[bounds[i] : bounds[i + 1]] - (i + 1) * self.size for i, g in enumerate(grams.names)}

    def find(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        kind, parts = query
        found = sorted((self.find(q) for q in parts), key=len)
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if kind == "and" else np.union1d(out, x)
        return out


def compiled(rules: tuple[Rule, ...]) -> tuple[list[tuple[Rule, re.Pattern, object]], Grams]:
    out = [(r, re.compile(r.pattern, FLAGS | (re.IGNORECASE if r.any_case else 0)), trigrams(r.pattern)) for r in rules]
    return out, Grams(set().union(*(_names(q) for _, _, q in out)))


def spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule number, end), sorted."""
    ready, grams = compiled(rules)
    index, out = Index(texts, grams), [[] for _ in texts]
    for number, (rule, pattern, query) in enumerate(ready):
        for i in index.find(query).tolist():
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), number, m.end()))
    return [sorted(x) for x in out]


def find(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """docs with an array of (kind, base, start, end), sorted by start and then by the order of the rules."""

    @F.pandas_udf("array<struct<kind: string, base: boolean, start: long, end: long>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": rules[k].kind, "base": rules[k].base, "start": a, "end": b} for a, k, b in x] for x in spans(texts.tolist(), rules)])

    return docs.withColumn(name, found(F.coalesce(F.col(text), F.lit(""))))


def mask(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every span, or what overlapping spans cover together, replaced by the mark."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def masked(text: Column, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> Column:
    """The masked text where there is something to mask, else null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        given = texts.tolist()
        return pd.Series([mask(t, x, mark) if x else None for t, x in zip(given, spans(given, rules), strict=True)], dtype=object)

    return clean(F.coalesce(text, F.lit("")))
