"""Secrets in project documents, found through an inverted index of trigrams."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelspark.llm import units

# Bytes of text that share one index, and the largest sets kept while a query is derived.
SHARD_BYTES = 1 << 22
MOST_TEXTS = 32
MOST_CLAUSES = 64

SECRETS = "project_id {0}, secrets array<struct<kind: string, start: long, stop: long>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: where `pattern` matches and its group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The kinds every document is searched for. A run of one class is taken whole, so asking for its
# length in the pattern keeps the same runs as measuring it afterwards.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Public formats of keys and tokens.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("repo", r"gh[opsu]_[A-Za-z0-9]{30,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url", r"[a-z]{2,10}://[A-Za-z0-9._-]+:[A-Za-z0-9._~-]+@"),
)

# A query is an "or" of clauses, each an "and" of trigrams. The empty clause asks for nothing.
Clauses = frozenset
ANYTHING: Clauses = frozenset([frozenset()])


def _fewest(clauses) -> Clauses:
    """Without the clauses that ask for more than another one."""
    kept: list[frozenset] = []
    for clause in sorted(clauses, key=len):
        if not any(k <= clause for k in kept):
            kept.append(clause)
    return frozenset(kept)


def _both(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > MOST_CLAUSES:
        return min(a, b, key=lambda q: (q == ANYTHING, len(q)))  # one of two necessary conditions is still necessary
    return _fewest(x | y for x in a for y in b)


def _trigrams(texts) -> Clauses:
    return _fewest(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)


@dataclass(frozen=True)
class _Part:
    """What is known of the texts that a part of a pattern matches.

    whole: all of them, where they are few. Otherwise each begins with one of heads, ends with one of tails, and
    satisfies asks.
    """

    whole: frozenset | None = None
    heads: frozenset = frozenset([b""])
    tails: frozenset = frozenset([b""])
    asks: Clauses = ANYTHING

    def opened(self) -> _Part:
        return self if self.whole is None else _Part(None, self.whole, self.whole, _trigrams(self.whole))


_UNKNOWN = _Part()
_EMPTY = _Part(frozenset([b""]))


def _product(a, b) -> frozenset | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MOST_TEXTS else None


def _in_sequence(a: _Part, b: _Part) -> _Part:
    if a.whole is not None and b.whole is not None and (whole := _product(a.whole, b.whole)) is not None:
        return _Part(whole)
    x, y = a.opened(), b.opened()
    heads = _product(a.whole, y.heads) if a.whole is not None else None
    tails = _product(x.tails, b.whole) if b.whole is not None else None
    seam = _product(frozenset(t[-2:] for t in x.tails), frozenset(t[:2] for t in y.heads))
    asks = _both(x.asks, y.asks)
    for texts in (seam, heads, tails):
        if texts is not None:
            asks = _both(asks, _trigrams(texts))
    return _Part(None, x.heads if heads is None else heads, y.tails if tails is None else tails, asks)


def _either(parts: Sequence[_Part]) -> _Part:
    if all(p.whole is not None for p in parts) and len(whole := frozenset().union(*(p.whole for p in parts))) <= MOST_TEXTS:
        return _Part(whole)
    opened = [p.opened() for p in parts]
    ends = [frozenset().union(*(getattr(p, side) for p in opened)) for side in ("heads", "tails")]
    ends = [e if len(e) <= MOST_TEXTS else frozenset([b""]) for e in ends]
    asks = frozenset().union(*(p.asks for p in opened))
    return _Part(None, *ends, _fewest(asks) if len(asks) <= MOST_CLAUSES else ANYTHING)


def _folded(code: int) -> bytes:
    return chr(code + 32 if 65 <= code <= 90 else code).encode("utf-8", "surrogatepass")


def _part(tree) -> _Part:
    out = _EMPTY
    for name, value in tree:
        name = str(name)
        if name == "LITERAL":
            part = _Part(frozenset([_folded(value)]))
        elif name == "IN":
            codes = None if any(str(kind) not in ("LITERAL", "RANGE") for kind, _ in value) else [
                range(v, v + 1) if str(kind) == "LITERAL" else range(v[0], v[1] + 1) for kind, v in value
            ]
            few = codes is not None and sum(map(len, codes)) <= MOST_TEXTS
            part = _Part(frozenset(_folded(c) for r in codes for c in r)) if few else _UNKNOWN
        elif name == "SUBPATTERN":
            part = _part(value[-1])
        elif name == "BRANCH":
            part = _either([_part(branch) for branch in value[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = value
            once = _part(body)
            part = functools.reduce(_in_sequence, itertools.repeat(once, min(least, 4)), _EMPTY)
            if least == 0 and most == 1:
                part = _either([_EMPTY, once])
            elif least == 0:
                part = _UNKNOWN
            elif most != least or least > 4:
                part = part.opened()
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            part = _EMPTY
        else:
            part = _UNKNOWN
        out = _in_sequence(out, part)
    return out


def trigram_query(rule: Rule) -> Clauses:
    """Trigrams (bytes of the text in lower case) that a text must hold to match: an "or" of "and"s.

    Derived from the rule's parsed pattern. A rule without mandatory trigrams gives `ANYTHING`.
    """
    return _part(re._parser.parse(rule.pattern, re.ASCII)).opened().asks


class Index:
    """Postings of one shard: for each trigram that some rule asks for, the rows that hold it."""

    def __init__(self, codes: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        """codes: sorted numbers of the trigrams asked for."""
        self.rows = len(offsets) - 1
        folded = units.LOWER[data].astype(np.int32)
        grams = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
        wanted = np.zeros(1 << 24, bool)
        wanted[codes] = True
        hits = np.flatnonzero(wanted[grams]) if len(grams) else np.zeros(0, np.int64)
        row = np.searchsorted(offsets, hits, "right") - 1
        inside = hits + 3 <= offsets[row + 1]
        pairs = np.unique(np.searchsorted(codes, grams[hits[inside]]) * np.int64(max(1, self.rows)) + row[inside])
        which, held = np.divmod(pairs, max(1, self.rows))
        self.postings = np.split(held, np.searchsorted(which, np.arange(1, len(codes))))
        self.numbers = {int(c): i for i, c in enumerate(codes)}

    def candidates(self, query: Clauses) -> np.ndarray:
        """Rows that hold all trigrams of some clause."""
        if query == ANYTHING:
            return np.arange(self.rows)
        found = []
        for clause in query:
            lists = sorted((self.postings[self.numbers[int.from_bytes(t, "big")]] for t in clause), key=len)
            found.append(functools.reduce(functools.partial(np.intersect1d, assume_unique=True), lists))
        return functools.reduce(np.union1d, found)


def find_secrets(documents: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Spans of secrets in every project document.

    documents: project_id (any type), document (string); other columns are ignored. Each row stays a row, repeated
    and null ids included; a null document reads as empty. Every shard of whole documents gets an inverted index of
    the trigrams that some rule asks for; a rule's Boolean query intersects and joins its postings, and its pattern
    runs on the whole texts of the candidates alone. Rules without mandatory trigrams run on all. Nothing is shuffled,
    and a task holds one shard (one document, if that is longer) at a time.

    Returns project_id and secrets: kind, start and stop in code points, by start, then the order of the rules. Matches
    of one kind are leftmost and do not overlap; a match whose group is too short is dropped.
    """
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("each rule needs a kind of its own")
    asked = [(rule, trigram_query(rule)) for rule in rules]
    codes = np.array(sorted({int.from_bytes(t, "big") for _, q in asked for clause in q for t in clause}), np.int32)
    texts = documents.select("project_id", F.col("document").cast("string").alias("document"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(rule, query, rule.compiled()) for rule, query in asked]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for part, data, offsets in units.slices(batch, "document", SHARD_BYTES):
                index = Index(codes, data, offsets)
                found: list[list] = [[] for _ in range(index.rows)]
                for order, (rule, query, pattern) in enumerate(patterns):
                    for row in index.candidates(query).tolist():
                        text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
                        for m in pattern.finditer(text):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[row].append((m.start(), order, m.end()))
                spans = [[{"kind": patterns[k][0].kind, "start": a, "stop": b} for a, k, b in sorted(f)] for f in found]
                yield pa.record_batch([part.column(part.schema.get_field_index("project_id")), pa.array(spans, kind)], ["project_id", "secrets"])

    return texts.mapInArrow(step, SECRETS.format(texts.schema["project_id"].dataType.simpleString()))
