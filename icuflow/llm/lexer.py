"""Name-literal pairs of source and configuration text.

Text is lexed into names, strings (prefixed, triple, escaped quotes), operators, brackets, tags and statement ends; what stands left of an
assignment since the statement began gives the targets, what stands right of it the literals. Read are

* ``name = "x"``, ``name: x``, ``"name": "x"``, ``cfg["name"] = "x"``, ``name := x``, ``name => x``, ``char name[64] = "x"``, ``var name string = "x"``
* annotated targets (``name: str = "x"``, ``const name: string = "x"``), tuples of targets and of values, ``#define NAME "x"``
* lists of literals, literals in brackets, side by side, joined by ``+ . .. &`` or given as fallbacks by ``or || ??``; names inside f-strings
* indented blocks after ``name: |`` and ``name: >``, and strings of several lines: one piece a line, lines of dashes left out
* attributes and texts of tags, with the name that a ``key``, ``name`` or ``id`` attribute gives
* calls that set or get a value under a name: ``put("name", "x")``, ``getenv("name", "x")``, ``setName("x")``

Strings that hold ``=`` or ``:`` are lexed again as texts of their own. Comparisons are no assignments. Work grows with the text: a
place is lexed once for each string it is nested in.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from typing import NamedTuple


class Piece(NamedTuple):
    text: str
    start: int
    quoted: bool  # else a bare value, which may be the name of a constant


class Pair(NamedTuple):
    name: str
    pieces: list[Piece]  # joined; none if the value is no literal
    constant: bool  # from here on the name stands for the value


QUOTED = r"""
    (?P<prefix>(?<!\w)[rRbBuUfF$@]{1,2}(?=["'`])|)
    (?:\"{3}(?P<triple>(?s:.*?))\"{3}|'{3}(?P<tripled>(?s:.*?))'{3}
    |\\"(?P<escaped>[^"\\\n]*+)\\"|\\'(?P<escapes>[^'\\\n]*+)\\'
    |"(?P<double>(?:[^"\\\n]|\\.)*+)"
    |(?:(?<!\w)|(?<=\b[rRbBuUfF])|(?<=\b[rRbBuUfF]{2}))'(?P<single>(?:[^'\\\n]|\\.)*+)'
    |`(?P<tick>[^`\n]*+)`)"""
STRING = re.compile(QUOTED, re.X | re.A)
INSIDE = ("triple", "tripled", "escaped", "escapes", "double", "single", "tick")
SCAN = re.compile(
    rf"""(?P<string>{QUOTED})
    |(?P<end>[\n;])|(?P<open>[({{])|(?P<close>[)}}])|(?P<mark>[\[\],])
    |\#[ \t]*+define[ \t]++(?P<macro>[A-Za-z_]\w*+)(?=[ \t])
    |(?P<tag><(?=[A-Za-z]))
    |(?P<passed>[=!<>]==?|::|://)
    |(?P<operator>:=|=>|\?\?=|\|\|=|[+?.]?=|:)
    |(?P<name>[A-Za-z0-9_$@][\w.\-$]*+)""",
    re.X | re.A,
)
SPACE, WIDE = re.compile(r"(?:[ \t]|\\\n)*+"), re.compile(r"\s*+")
BARE = re.compile(r"[A-Za-z0-9+/_.\-~$%{}!@#^&*]++={0,2}")
NAME = re.compile(r"[A-Za-z_][\w.]*\Z", re.A)
KEY = re.compile(r"[\w.\- ]*[A-Za-z_][\w.\-]*\Z", re.A)
JOINED = re.compile(r"[ \t]*+\+[ \t]*+(?=[\"'`A-Za-z_])")
JOINED_STRING = re.compile(r"\s*+(?:\+|\.\.?|&(?!&))\s*+(?=[\"'`A-Za-z_$])")
GLUED = re.compile(r"[rRbBuUfF]{0,2}[ \t]*[\"'`]")  # what follows the + of a name that is joined without a blank
FALLBACK = re.compile(r"\s*+(?:\|\||\?\?|\bor\b)(?!=)\s*+")
CALLED = re.compile(r"[ \t]*+\(")
CALL_OR = re.compile(r"""[A-Za-z_][\w.]*+\((?:[^()\n"']|"[^"\n]*+"|'[^'\n]*+')*+\)[ \t]*+(?:\|\||\?\?|or\b)(?!=)""", re.A)
ITEM = re.compile(r"""\s*+(?:"[^"\n]*+"|'[^'\n]*+')\s*+[,}]""")
ANNOTATION = re.compile(
    r"""[ \t]*+(?:&(?:'static[ \t]+)?)?(?!(?i:pass|pwd|secret|token|key))(?:str|string|bytes|any|unknown|object|char|[A-Z]\w*+(?:\.\w+)*|\w+(?:\.\w+)+)
    (?:\[[^\]\n=]*+\]+)?(?:[ \t]*+\|[ \t]*+\w++(?:\[[^\]\n=]*+\]+)?)*+\??(?:[ \t]++=(?![=>~])|=(?=["'`]))""",
    re.X | re.A,
)
BLOCK = re.compile(r"[ \t]*+[|>][+\-\d]*+[ \t]*+(?:#[^\n]*+)?\n")
LINE = re.compile(r"([ \t]*+)([^\n]*+)\n?")
DASHES = re.compile(r"-----.*-----\Z")
INTERPOLATED = re.compile(r"\$?\{([A-Za-z_]\w*)\}", re.A)
TAG = re.compile(r"""<([A-Za-z][\w:.\-]*+)((?:\s++[\w:.\-]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'))*+)\s*+(/?)>""", re.A)
ATTRIBUTE = re.compile(r"""([\w:.\-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""", re.A)
ELEMENT = re.compile(r"\s*+(?:<!\[CDATA\[([^\]<]*+)\]\]>\s*+|([^<]*+))</([A-Za-z][\w:.\-]*+)", re.A)
NAMING = ("key", "name", "id")
ACCESSOR = re.compile(r"(?i)(?:set|get|put|add|env|define|insert|config|option)\w*\Z")
SETTER = re.compile(r"(?:.*\.)?[sS]et_?([A-Za-z]\w*)\Z", re.A)
ARGUMENT = re.compile(r"""\s*+(?:"([\w.\-]++)"|'([\w.\-]++)')\s*+,""", re.A)
TYPES = {"string", "String", "str", "bytes", "byte"}
KEYWORDS = {"var", "let", "const", "local", "my", "our", "val", "export", "static", "final", "global"}


def pairs(text: str, constants: Container[str]) -> Iterator[Pair]:
    """Pairs in the order of the text, nested texts after it; the caller keeps ``constants`` up to date as it reads."""
    todo = [(0, len(text))]
    while todo:
        yield from statements(text, *todo.pop(), constants, todo)


def inside(m: re.Match) -> tuple[int, int]:
    return m.span(next(g for g in INSIDE if m[g] is not None))


def lines(text: str, low: int, high: int) -> list[Piece]:
    """One piece a line, without its margins; lines of dashes (the frame of a key file) are left out."""
    found = []
    for row in text[low:high].split("\n"):
        bare = row.strip()
        if bare and not DASHES.match(bare):
            found.append(Piece(bare, low + len(row) - len(row.lstrip()), True))
        low += len(row) + 1
    return found


def quoted(text: str, m: re.Match, constants: Container[str]) -> list[Piece]:
    """The pieces of a string: its lines, or its literal parts with the constants named between them."""
    low, high = inside(m)
    if (m["triple"] or m["tripled"]) and "\n" in text[low:high]:
        return lines(text, low, high)
    pieces, formatted = [], "f" in m["prefix"].lower() or "$" in m["prefix"]
    for slot in INTERPOLATED.finditer(text, low, high):
        if slot[1] in constants and (formatted or slot[0][0] == "$"):
            if slot.start() > low:
                pieces.append(Piece(text[low : slot.start()], low, True))
            pieces.append(Piece(slot[1], slot.start(1), False))
            low = slot.end()
    if low < high or not pieces:
        pieces.append(Piece(text[low:high], low, True))
    return pieces


def chain(text: str, at: int, high: int, constants: Container[str], wrapped: bool) -> tuple[list[Piece], int]:
    """Pieces that are joined or stand side by side, and where they end; none for a call or anything else that is no literal."""
    pieces, blank = [], WIDE if wrapped else SPACE
    while True:
        start = blank.match(text, at, high).end()
        if m := STRING.match(text, start, high):
            pieces += quoted(text, m, constants)
            at = m.end()
            if joined := JOINED_STRING.match(text, at, high):
                at = joined.end()
            elif not STRING.match(text, blank.match(text, at, high).end(), high):
                return pieces, at
            continue
        m = BARE.match(text, start, high)
        if not m:
            return pieces, at
        piece, at = m[0], m.end()
        if NAME.match(piece) and CALLED.match(text, at, high):
            return [], start
        if piece.endswith("}") and "{" not in piece:
            piece = piece.rstrip("}")
            at = start + len(piece)
            if not piece:
                return pieces, start
        names, glued = [], False
        if "+" in piece:
            cut = piece.rindex("+")
            glued = GLUED.match(text, start + cut + 1, high) is not None
            names = (piece[:cut] if glued else piece).split("+")
            if not all(NAME.match(x) and (glued or x in constants) for x in names):
                names, glued = [], False
            elif glued:
                at = start + cut + 1
        for x in names or [piece]:
            pieces.append(Piece(x, start, False))
            start += len(x) + 1
        if glued:
            continue
        joined = JOINED.match(text, at, high)
        if not joined:
            return pieces, at
        at = joined.end()


def right_side(
    text: str, at: int, high: int, constants: Container[str], many: bool, todo: list[tuple[int, int]]
) -> tuple[list[list[Piece]], int]:
    """The values right of an assignment, and where they end: one, or those of a list, of fallbacks or of a tuple."""
    values, opened = [], 0
    while True:
        at = (WIDE if opened else SPACE).match(text, at, high).end()
        sign = text[at] if at < high else ""
        if sign and (sign in "([" or sign == "{" and ITEM.match(text, at + 1, high)):
            opened, at = opened + 1, at + 1
            continue
        if opened and sign and sign in ")]}":
            opened, at = opened - 1, at + 1
            if opened:
                continue
            return values, at
        if opened and sign == ",":
            at += 1
            continue
        pieces, end = chain(text, at, high, constants, opened > 0)
        follows = WIDE.match(text, end, high).end() if opened else end
        if opened and text[follows : follows + 1] in (":", "=") and follows < high:  # a key or a named argument: a statement of its own
            return values, at
        if pieces:
            values.append(pieces)
        elif call := CALL_OR.match(text, end, high):
            todo.append(call.span())
            at = call.end()
            continue
        elif opened or not FALLBACK.match(text, end, high):
            return values, end
        at = end
        if fallback := FALLBACK.match(text, at, high):
            at = fallback.end()
        elif many and not opened and (comma := SPACE.match(text, at, high).end()) < high and text[comma] == ",":
            at = comma + 1
        elif not opened:
            return values, at


def targets(left: list[tuple[str, str]], many: bool) -> list[tuple[str, bool]]:
    """Names that the statement so far assigns to, in order, and whether they are variables (not keys of one)."""
    i = len(left) - 1
    while i >= 0 and left[i][1] == "]" and left[i][0] == "mark":
        if i >= 2 and left[i - 2] == ("mark", "["):
            if left[i - 1][0] == "string":
                return [(left[i - 1][1], False)] if KEY.match(left[i - 1][1]) else []
            i -= 3
        elif i >= 1 and left[i - 1] == ("mark", "["):
            i -= 2
        else:
            return []
    if i < 0 or left[i][0] == "mark":
        return []
    if left[i][0] == "string":
        return [(left[i][1], True)] if KEY.match(left[i][1]) else []
    if left[i][1] in TYPES and i and left[i - 1][0] == "name":
        i -= 1
    found = [(left[i][1], True)]
    while many and i >= 2 and left[i - 1] == ("mark", ",") and left[i - 2][0] == "name":
        i -= 2
        found.append((left[i][1], True))
    if i and left[i - 1][1] not in KEYWORDS:
        return found[:1]
    return found[::-1]


def block(text: str, operator: int, at: int, high: int) -> int:
    """Where the lines end that are indented deeper than the line of the operator."""
    first = text.rfind("\n", 0, operator) + 1
    margin = len(LINE.match(text, first)[1])
    while at < high:
        line = LINE.match(text, at, high)
        if line[2] and len(line[1]) <= margin:
            break
        at = line.end()
    return at


def tag(text: str, m: re.Match, high: int, todo: list[tuple[int, int]]) -> Iterator[Pair]:
    """Attributes of a tag, its text under the tag's name, and value and text under the name that an attribute gives."""
    given, value = None, None
    for a in ATTRIBUTE.finditer(text, *m.span(2)):
        group = 2 if a[2] is not None else 3
        piece = Piece(a[group], a.start(group), True)
        yield Pair(a[1], [piece], False)
        if "=" in piece.text or ":" in piece.text:
            todo.append(a.span(group))
        if a[1].lower() in NAMING and KEY.match(piece.text):
            given = piece.text
        if a[1].lower() == "value":
            value = piece
    if given and value:
        yield Pair(given, [value], False)
    element = ELEMENT.match(text, m.end(), high) if not m[3] else None
    if element and element[3] == m[1]:
        low, top = element.span(1 if element[1] is not None else 2)
        pieces = lines(text, low, top)
        for name in (m[1], given):
            if name and pieces:
                yield Pair(name, pieces, False)


def statements(text: str, low: int, high: int, constants: Container[str], todo: list[tuple[int, int]]) -> Iterator[Pair]:
    left: list[tuple[str, str]] = []
    depth, at = 0, low
    while m := SCAN.search(text, at, high):
        kind, at = m.lastgroup, m.end()
        if kind == "name":
            left.append(("name", m[0].strip(".-")))
        elif kind == "string":
            start, end = inside(m)
            left.append(("string", text[start:end]))
            if "=" in left[-1][1] or ":" in left[-1][1]:
                todo.append((start, end))
        elif kind == "mark":
            left.append(("mark", m[0]))
        elif kind == "end":
            left.clear()
            if text[m.start() - 1 : m.start()] == "\n" or m[0] == ";":
                depth = 0
        elif kind == "close":
            left.clear()
            depth = max(0, depth - 1)
        elif kind == "open":
            called = left[-1][1] if m[0] == "(" and left and left[-1][0] == "name" else ""
            left.clear()
            depth += 1
            if called and ACCESSOR.match(called.rpartition(".")[2]) and (argument := ARGUMENT.match(text, at, high)):
                pieces, at = chain(text, argument.end(), high, constants, True)
                if pieces and pieces[0].quoted:
                    yield Pair(argument[1] or argument[2], pieces, False)
            elif called and (setter := SETTER.match(called)) and STRING.match(text, at, high):
                pieces, at = chain(text, at, high, constants, True)
                yield Pair(setter[1], pieces, False)
        elif kind == "macro":
            left.clear()
            pieces, at = chain(text, at, high, constants, False)
            yield Pair(m["macro"], pieces, True)
        elif kind == "tag":
            if opening := TAG.match(text, m.start(), high):
                yield from tag(text, opening, high, todo)
                at = opening.end()
        elif kind == "operator":
            names = targets(left, depth == 0 and m[0] in ("=", ":="))
            left.clear()
            if not names:
                continue
            if m[0] == ":" and (typed := ANNOTATION.match(text, at, high)):
                at = typed.end()
            elif m[0] == ":" and (opening := BLOCK.match(text, at, high)):
                end = block(text, m.start(), opening.end(), high)
                yield Pair(names[-1][0], lines(text, opening.end(), end), names[-1][1])
                todo.append((opening.end(), end))
                at = end
                continue
            begin = at
            values, at = right_side(text, at, high, constants, len(names) > 1, todo)
            nested(text, begin, at, todo)
            if len(names) > 1 and len(values) == len(names):
                for (name, constant), pieces in zip(names, values):
                    yield Pair(name, pieces, constant)
                continue
            for pieces in values or [[]]:
                yield Pair(names[-1][0], pieces, names[-1][1] and len(values) < 2)


def nested(text: str, low: int, high: int, todo: list[tuple[int, int]]) -> None:
    """Strings of a right side that hold assignments themselves."""
    if "=" in (part := text[low:high]) or ":" in part:
        for m in STRING.finditer(text, low, high):
            start, end = inside(m)
            if "=" in text[start:end] or ":" in text[start:end]:
                todo.append((start, end))
