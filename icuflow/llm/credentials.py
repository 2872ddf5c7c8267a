"""Secret scans: pattern matches, and literals found by lexing assignments.

The lexer (:mod:`icuflow.llm.lexer`) gives name-literal pairs. Names that were given a literal earlier in the text stand for it (constants
are propagated). Values are kept as graphs of their literals, never as joined strings, so values of any length are read, also those that
repeated constants make longer than any memory. A literal is reported when the sensitivity of the name it reaches, times how much it looks
like a credential, is high enough; a literal of several lines has a span a line.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.llm.batches import add_columns
from icuflow.llm.lexer import pairs

# The patterns of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

KINDS = ("assign", "access", "hex", "lexed")
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))
FIELDS = "secrets array<struct<kind:string,start:int,end:int,name:string,score:double>>"

SENSITIVE = {  # word of a name: how surely its value is a credential
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "pass": 0.8, "bearer": 0.9, "auth": 0.6, "authorization": 0.9, "signature": 0.5, "salt": 0.5, "cert": 0.5,
}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9,
         ("encryption", "key"): 0.9, ("client", "secret"): 1.0, ("connection", "string"): 0.7}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|change_?me|example.*|your[_-].*|none|null|nil|true|false|todo|undefined|test|dummy)$")

WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
DESCRIBING = {  # last words of names that hold something about a credential, not the credential
    "file", "path", "name", "dir", "directory", "folder", "url", "uri", "id", "type", "length", "len", "size", "count", "field", "label", "prompt", "hint",
    "policy", "expiry", "expires", "ttl", "timeout", "regex", "pattern", "env", "var", "variable", "ref", "arn", "endpoint", "input", "form", "manager",
    "provider", "header", "column", "algorithm", "format", "version", "rate", "limit", "encoder", "service", "server", "host", "issuer",
}
DESCRIBED = 0.3  # how much of a name's sensitivity is left then
MENTIONS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "signature", "salt", "cert", "connection")  # one is in every sensitive name
LOCATION = re.compile(r"(?:/|\.{1,2}/|~/|[A-Za-z]:\\)[\w.\-/\\]*\Z", re.A)
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^@\s]*\Z")
IDENTIFIER = re.compile(r"[A-Za-z]+(?:[_.\-][A-Za-z]+)+\Z")
ELSEWHERE = 0.2  # what is left of a literal that looks like a place or like another name


def name_score(name: str) -> float:
    """How surely a target of this name holds a credential, 0 to 1."""
    words = [w.lower() for w in WORDS.findall(name) if not w.isdigit()]
    single = [w if w.endswith("ss") else w.removesuffix("s") for w in words]  # tokens count as a token
    sure = max([SENSITIVE.get(w, 0.0) for w in single] + [PAIRS.get(p, 0.0) for p in zip(single, single[1:])], default=0.0)
    return sure * DESCRIBED if words and words[-1] in DESCRIBING else sure


class Value:
    """A literal, or literals and values joined: what scoring needs of it, and the best score of the targets it reached."""

    __slots__ = ("parts", "span", "length", "head", "tail", "counts", "best")

    def __init__(self, piece: str = "", span: tuple[int, int] = (0, 0), parts: tuple[Value, ...] = ()):
        self.parts, self.span, self.best = parts, span, (0.0, "")
        if not parts:
            self.length, self.head, self.tail, self.counts = len(piece), piece, piece, None
            return
        self.length = sum(p.length for p in parts)
        scale = MOST / self.length if self.length > MOST else 1  # shares stay, numbers stay small
        self.head = "".join(p.head[:ENDS] for p in parts)[:ENDS] if self.length > ENDS else "".join(p.head for p in parts)
        self.tail = "".join(p.tail[-ENDS:] for p in parts)[-ENDS:]
        self.counts = Counter()
        for part in parts:
            self.counts.update(part.characters())
        if scale != 1:
            self.length, self.counts = MOST, Counter({c: k * scale for c, k in self.counts.items()})

    def characters(self) -> Counter:
        if self.counts is None:
            self.counts = Counter(self.head)
        return self.counts

    def score(self) -> float:
        """How much the value looks like a credential, 0 to 1: length, entropy and character classes; placeholders have 0."""
        n, counts = self.length, self.characters()
        seen = "".join(counts)
        if n < LEAST_VALUE or any(c.isspace() for c in seen) or PLACEHOLDER.match(self.head if len(self.head) == n else self.head + seen + self.tail):
            return 0.0
        bits = -sum(k / n * math.log2(k / n) for k in counts.values() if k)
        classes = sum(bool(re.search(p, seen)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        looks = min(1.0, bits / 3.0) * min(1.0, 0.4 + 0.3 * classes)
        if len(self.head) < n:
            return looks
        place = LOCATION.match(self.head) and not (re.search("[A-Z]", seen) and re.search("[0-9]", seen))
        return looks * ELSEWHERE if place or ADDRESS.match(self.head) else looks


ENDS = 256  # characters of a joined value that are kept at both ends
MOST = 2.0**60  # length from which only the shares of a joined value's characters count


def literal_score(value: str) -> float:
    return Value(value).score()


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, name): leftmost non-overlapping matches of each base kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access", "") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", "") for m in HEX.finditer(text)]
    return found


def assignments(text: str):
    """(target name, value, how much of its score counts) in order; constants are propagated, joined pieces become one value."""
    constants: dict[str, Value] = {}
    for name, pieces, constant in pairs(text, constants):
        parts = tuple(
            constants[p.text] if not p.quoted and p.text in constants else Value(p.text, (p.start, p.start + len(p.text))) for p in pieces if p.text
        )
        if not parts:
            if constant:
                constants.pop(name, None)
            continue
        value = parts[0] if len(parts) == 1 else Value(parts=parts)
        bare = len(pieces) == 1 and not pieces[0].quoted and pieces[0].text not in constants
        another = bare and (IDENTIFIER.match(pieces[0].text) or name_score(pieces[0].text) > 0)  # a name that is not known here
        if constant and not (bare and pieces[0].text == name):
            constants[name] = value
        yield name, value, ELSEWHERE if another else 1.0


def lexed_spans(text: str, least: float = 0.6) -> list[tuple[int, int, str, str, float]]:
    """(start, end, kind, name, score) of the literals that reach a sensitive name, each once, with its best score."""
    values: dict[int, Value] = {}  # parts stand before what they are joined to
    found = False
    folded = text.lower()
    for target, value, counts in assignments(text) if any(w in folded for w in MENTIONS) else ():
        for part in (*value.parts, value):
            values.setdefault(id(part), part)
        if (sure := name_score(target)) and (score := sure * counts * value.score()) >= least:
            value.best, found = max(value.best, (score, target)), True
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for value in reversed(values.values()) if found else ():
        if value.best[0]:
            for part in value.parts:
                part.best = max(part.best, value.best)
            if not value.parts and value.length:
                best[value.span] = value.best
    return [(low, high, "lexed", name, score) for (low, high), (score, name) in sorted(best.items())]


def spans_of(text: str) -> list[dict]:
    """All spans of a text by start, then kind in the order of KINDS, then end; code points, end exclusive."""
    found = [(*x, 1.0) for x in base_spans(text)]
    found += lexed_spans(text)
    found.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return [dict(zip(("start", "end", "kind", "name", "score"), x)) for x in found]


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``secrets``: spans of the three base kinds and of lexed literals, for every whole text.

    Null texts read as empty and have no spans, as have empty texts; repeated rows get the same spans; other columns stay, save
    one named ``secrets``, which is replaced; an empty table gives no rows. Each text is scanned alone in its task.
    """
    return add_columns(df, text, lambda column: [pa.array([spans_of(t or "") for t in column.to_pylist()], SPANS)], FIELDS)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
