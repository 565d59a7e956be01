"""Secret scan: base patterns, and literals that an assignment-aware lexer ties to sensitive names.

The lexer reads source and configuration syntax (name = "x", "name": "x", name => 'x', export NAME=x,
name: x) into name-literal pairs. A name bound to a literal is a constant; where it, or a + of constants and
literals, is assigned to a sensitive name, its literals count for that name. A literal is scored by the name and
by its own length, variety and entropy; placeholders lose. Texts without a sensitive name are not lexed.

Rows: a null text counts as empty; equal rows give equal results; a null doc_id is kept; other columns are
ignored; an empty table gives an empty result. Spans are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.encoding import pieces

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a shorter run has no later start that is long enough
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "lexed"]
SENSITIVE = re.compile(r"passw(?:or)?d|passphrase|\bpwd\b|secret|token|api_?key|private_?key|access_?key|auth_?key|credential|bearer|client_?key", re.I | re.A)
PLACEHOLDER = re.compile(r"change_?me|example|placeholder|dummy|your[_-]|xxx|\*\*\*|<[^>]*>|\$\{|\{\{|getenv|environ|^(?:none|null|true|false|undefined|todo)$", re.I | re.A)
LEXEME = re.compile(r"""(?P<comment>/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`)|(?P<op>=>|:=|==|!=|<=|>=|[=:+])|(?P<word>[^\s"'`=:+,;(){}\[\]<>]+)|(?P<end>[\n,;(){}\[\]<>])|(?P<other>["'`])""", re.S)
PLAIN = re.compile(LEXEME.pattern.replace(r"(?P<comment>/\*.*?\*/)|", ""), re.S)
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.-]*", re.A)
SCORE = 4
REPEATS = 10_000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches without overlap of each kind; an assignment's value has at least eight characters."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def lexemes(text: str):
    """Matches of LEXEME in order. Behind the last end of a comment none is looked for, so that an open one is scanned once."""
    at, last = 0, text.rfind("*/")
    while m := (LEXEME if at <= last else PLAIN).search(text, at):
        yield m
        at = m.end()


def assignments(text: str):
    """(name, [operands]) for each assignment; an operand is (literal or None, constant name or None, start, end)."""
    name, operands, reading = None, [], False
    before = None  # the last word or string, which an operator may make a name
    for m in lexemes(text):
        kind, value = m.lastgroup, m[0]
        if kind in ("comment", "other"):
            continue
        if kind == "op" and value in ("=", ":", ":=", "=>"):
            if before is not None:
                if reading and operands:
                    operands.pop()  # it was the next name, not the end of the last value
                    if operands:
                        yield name, operands
                name, operands, reading, before = before, [], True, None
        elif kind == "op" and value == "+":
            before = None
        elif kind in ("word", "str"):
            quoted = kind == "str"
            inner = value[1:-1] if quoted else value
            if reading:
                if operands and before is not None:  # a second value without a +
                    yield name, operands
                    reading, operands = False, []
                else:
                    a = m.start() + quoted
                    constant = inner if not quoted and IDENTIFIER.fullmatch(inner) else None
                    operands.append((inner, constant, a, a + len(inner), quoted))
            before = inner
        else:
            if reading and operands:
                yield name, operands
            name, operands, reading, before = None, [], False, None
    if reading and operands:
        yield name, operands


def literal_score(name: str, literal: str) -> int:
    if not SENSITIVE.search(name):
        return 0
    if PLACEHOLDER.search(literal) or " " in literal.strip():
        return 0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 2 + (n >= 8) + (entropy >= 3) + (kinds >= 2) - (n < 6) * 2


class Parts:
    """What a name is bound to: literals (text, start, end) and the Parts of other names; size counts all literals."""

    __slots__ = ("items", "size")

    def __init__(self):
        self.items, self.size = [], 0

    def add(self, item, size: int):
        self.items.append(item)
        self.size += size

    def literals(self):
        """All literals in order. Over REPEATS of them, a name that comes again is left out: its spans are there already."""
        out, seen, todo = [], set(), [self]
        while todo:
            item = todo.pop()
            if isinstance(item, tuple):
                out.append(item)
            elif self.size <= REPEATS or id(item) not in seen:
                seen.add(id(item))
                todo += reversed(item.items)
        return out


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of literals that reach a sensitive name and score enough."""
    if not SENSITIVE.search(text):
        return []
    constants: dict[str, Parts] = {}
    out = set()
    for name, operands in assignments(text):
        parts = Parts()
        for literal, constant, a, b, quoted in operands:
            if constant in constants:
                parts.add(constants[constant], constants[constant].size)
            elif quoted or constant is None or any(c.isdigit() for c in literal):
                parts.add((literal, a, b), 1)
        if not parts.items:
            continue
        if IDENTIFIER.fullmatch(name):
            constants[name] = parts
        if not SENSITIVE.search(name):
            continue
        literals = parts.literals()
        if literal_score(name, "".join(p[0] for p in literals)) >= SCORE:
            out |= {(a, b) for _, a, b in literals if b > a}
    return [("lexed", a, b) for a, b in sorted(out)]


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, and of those the lexer finds what lies outside of them."""
    base, added = base_spans(text), []
    taken = sorted((a, b) for _, a, b in base)
    ends = list(accumulate((b for _, b in taken), max))
    for kind, a, b in lexed_spans(text):
        for at in range(bisect_right(ends, a), len(taken)):
            x, y = taken[at]
            if x >= b:
                break
            if a < x:
                added.append((kind, a, x))
            a = max(a, y)
        if a < b:
            added.append((kind, a, b))
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans in order, as array of (kind, start, end)."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def secret_digest(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "lexed")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
