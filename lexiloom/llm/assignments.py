"""Assignments in program and settings text: tokens, (name, value) pairs, constants passed on."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

# Every alternative either fails at once or takes what it read, so a text costs time in proportion to its length.
TOKEN = re.compile(
    r"""(?P<line>\n)
    |(?P<space>(?:[^\S\n]|\\\r?\n)++)
    |(?P<triple>(?:(?<!\w)[rbufRBUF]{1,2})?(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}))
    |(?P<string>(?:(?<!\w)[rbufRBUF]{1,2})?(?:"(?:[^"\\\n]|\\.)*+"|(?<![^\W_])'(?:[^'\\\n]|\\.)*+'(?!\w))|`(?:[^`\\\n]|\\.)*+`)
    |(?P<escape>\\.)
    |(?P<name>(?:[^\W\d]|\$)[\w$]*+(?:[.-](?:[^\W\d]|\$)[\w$]*+)*+)
    |(?P<number>\d\w*+(?:\.\w++)*+)
    |(?P<operator>===?|!==?|<=|>=|->|::|:/|=~|\*\*|[-*/%&|^~]=)
    |(?P<sign>:=|=>|=|:)
    |(?P<mark>//+|/\*+|\*+/|\#+|;|,)
    |(?P<open>[(\[{])
    |(?P<close>[)\]}])
    |(?P<join>\+=?|\.\.?|&)
    |(?P<other>.)""", re.VERBOSE)
BARE = re.compile(r"""[^\s"'`#;,(){}\[\]<>=]++=*+""")
IDENTIFIER = re.compile(r"(?:[^\W\d]|\$)[\w$]*(?:\.(?:[^\W\d]|\$)[\w$]*)*")
KEY = re.compile(r"[^\W\d][\w .-]{0,63}")
SECTION = re.compile(r"(?m)^\[[\w .:-]+\][ \t]*\r?$")
DIGIT = re.compile("[0-9]")
# No secret is longer; the values of constants joined again and again would be.
LONGEST = 8192


class Reference(NamedTuple):
    """A name in a value, at a place; ``bare`` is its span where settings syntax makes it a literal of itself."""

    name: str
    place: int
    bare: tuple[int, int] | None


class Assignment(NamedTuple):
    name: str
    constant: str | None
    place: int
    value: list


class Literal(NamedTuple):
    """A value as one text, the spans it is written in, and whether quotes enclose it."""

    text: str
    spans: tuple[tuple[int, int], ...]
    quoted: bool


def _content(text: str, start: int, end: int) -> tuple[int, int, bool]:
    """(start, end, formatted) of what a string token holds; blanks around the text in three quotes are left out."""
    first = start
    while text[first] not in "\"'`":
        first += 1
    marked = ("f" in text[start:first].lower() and "{" in text[first:end]) or (text[first] == "`" and "${" in text[first:end])
    quotes = 3 if end - first >= 6 and text[first:first + 3] == text[first] * 3 else 1
    a, b = first + quotes, end - quotes
    if quotes == 3:
        inside = text[a:b]
        a, b = a + len(inside) - len(inside.lstrip()), b - len(inside) + len(inside.rstrip())
    return (a, max(a, b), marked)


class _Reader:
    """The tokens of one text without blanks, and the assignments among them."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text) if m.lastgroup != "space"]
        section = SECTION.search(text)
        self.sections_from = section.start() if section else len(text)

    def assignments(self) -> list[Assignment]:
        """The assignments in the order of the text. They are read from the end, so that ``a = b = value`` takes the value of ``b``."""
        depths, depth = [], 0
        for i, (kind, _, _) in enumerate(self.tokens):
            depth = depth + 1 if kind == "open" else max(0, depth - 1) if kind == "close" else depth
            if kind == "line" and i and self.tokens[i - 1][0] == "line":
                depth = 0
            depths.append(depth)
        self.values: dict[int, list | None] = {}
        found, types = [], set()
        for i in range(len(self.tokens) - 1, -1, -1):
            kind, start, end = self.tokens[i]
            if kind != "sign" or not (target := self._target(i)):
                continue
            name, constant = target
            equals = self._past_type(i) if self.text[start:end] == ":" else None
            if equals:
                types.add(equals)
            self.values[i] = self._value(equals or i, name, constant, depths[i])
            if self.values[i]:
                found.append((i, Assignment(name, constant, start, self.values[i])))
        return [a for i, a in reversed(found) if i not in types]

    def _target(self, i: int) -> tuple[str, str | None] | None:
        """(name, constant it defines or None) that stands before the sign at ``i``."""
        if not i:
            return None
        kind, start, end = self.tokens[i - 1]
        if kind == "name":
            name = self.text[start:end]
            return name, name
        if kind == "close" and self.text[start] == "]" and i >= 4 and self.tokens[i - 3][0] == "open" and self.tokens[i - 4][0] in ("name", "close"):
            kind, start, end = self.tokens[i - 2]
        if kind == "string":
            a, b, _ = _content(self.text, start, end)
            if KEY.fullmatch(self.text, a, b):
                return self.text[a:b], None
        return None

    def _past_type(self, i: int) -> int | None:
        """Place of the ``=`` after a name's type, if the colon at ``i`` begins one."""
        j = i + 1
        if j >= len(self.tokens) or self.tokens[j][0] != "name":
            return None
        while (j := j + 1) < len(self.tokens):
            kind, start, end = self.tokens[j]
            if kind == "sign":
                return j if self.text[start:end] == "=" else None
            if kind not in ("name", "open", "close", "other") and self.text[start:end] != ",":
                return None
            if kind == "open" and self.text[start] != "[":
                return None
        return None

    def _value(self, i: int, name: str, constant: str | None, depth: int) -> list | None:
        """Strings, numbers and names joined into the value after the sign at ``i``; None for anything else."""
        bare = self._bare(i, name, depth)
        if bare:
            return [bare]
        parts, inside, wanted = [], 0, True
        j = i
        while (j := j + 1) < len(self.tokens):
            kind, start, end = self.tokens[j]
            if kind == "line":
                if inside or (parts and wanted) or (not parts and constant is None):
                    continue
                break
            if kind in ("string", "triple"):
                a, b, formatted = _content(self.text, start, end)
                if formatted:
                    return None
                parts.append((a, b, True))
                wanted = False
            elif kind == "number" and wanted:
                parts.append((start, end, False))
                wanted = False
            elif kind == "name" and wanted:
                follows = self.tokens[j + 1] if j + 1 < len(self.tokens) else ("line", end, end)
                if follows[0] == "open":
                    return None
                if follows[0] == "sign":
                    return self.values.get(j + 1) if self.text[follows[1]:follows[2]] == "=" and not parts and not inside else None
                parts.append(Reference(self.text[start:end], start, None))
                wanted = False
            elif kind == "open" and self.text[start] == "(" and wanted:
                inside += 1
            elif kind == "close" and self.text[start] == ")" and inside:
                inside -= 1
            elif kind == "join" and parts and not wanted:
                wanted = True
            elif (kind == "open" and (wanted or self.text[start] != "(")) or (parts and not wanted and self.text[start] in ("%*" if parts[-1][-1] is True else "%*-/")):
                return None
            else:
                break
        return None if wanted else parts

    def _bare(self, i: int, name: str, depth: int) -> tuple[int, int, bool] | Reference | None:
        """The unquoted value of settings syntax after the sign at ``i``, or None where the text is no such line."""
        _, sign, end = self.tokens[i]
        if i + 1 >= len(self.tokens) or self.tokens[i + 1][0] in ("line", "string", "triple", "open", "close", "mark", "sign"):
            return None
        start = self.tokens[i + 1][1]
        m = BARE.match(self.text, start)
        if not m or self.text[m.end():m.end() + 1] not in ("", *" \t\r\n#;,){}]<>"):
            return None
        ends_line = self.text[m.end():m.end() + 1] in ("", "\n", "\r") or not self.text[m.end():self._line_end(m.end())].strip()
        section = sign > self.sections_from and ends_line and depth == 0
        tight = self.text[sign] == "=" and start == end and not self.text[sign - 1].isspace()
        line = self.text[sign] == ":" and start > end and ends_line
        settings = section or tight or line
        if not IDENTIFIER.fullmatch(m[0]):
            return (*m.span(), False) if settings else None
        own = section or (depth == 0 and settings and DIGIT.search(m[0])) or (depth == 0 and tight and name.isupper())
        return Reference(m[0], start, m.span() if "." not in m[0] else None) if own else None

    def _line_end(self, place: int) -> int:
        end = self.text.find("\n", place, place + 64)
        return end if end >= 0 else min(len(self.text), place + 64)


def assigned_literals(text: str) -> Iterator[tuple[str, Literal]]:
    """(name, literal) of every assignment whose value is known from the text.

    A value is strings and numbers, joined or side by side, in brackets or not, on one line or
    several, and names that the text gives such a value: the last one before the place, else the first
    after it. A value with a call, a subscript, a filled-in string or a name of unknown value is
    no literal. Without quotes a value is a literal in settings lines: ``NAME=value``, ``name: value``
    and lines under a ``[section]``. What comments hold is read as well. Values over ``LONGEST`` characters are left out.
    """
    found = _Reader(text).assignments()
    places: dict[str, list[int]] = defaultdict(list)
    owners: dict[str, list[int]] = defaultdict(list)
    for k, a in enumerate(found):
        if a.constant:
            places[a.constant].append(a.place)
            owners[a.constant].append(k)

    def meant(r: Reference, user: int) -> int | None:
        at = bisect_left(places[r.name], r.place) if r.name in places else 0
        before = [k for k in owners.get(r.name, ())[max(0, at - 2):at] if k != user]
        return before[-1] if before else next((k for k in owners.get(r.name, ())[at:at + 2] if k != user), None)

    def joined(k: int) -> Literal | None:
        words, spans, quoted, length, local = [], [], False, 0, False
        for part in found[k].value:
            if isinstance(part, Reference):
                known = done.get(meant(part, k))
                if known is None and part.bare:
                    known = Literal(text[slice(*part.bare)], (part.bare,), False)
                if known is None:
                    return None
                words.append(known.text)
                spans += known.spans
                quoted, local = quoted or known.quoted, False
            else:
                start, end, marked = part
                words.append(text[start:end])
                if start < end:
                    if local:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((start, end))
                    local = True
                quoted = quoted or marked
            length += len(words[-1])
            if length > LONGEST:
                return None
        return Literal("".join(words), tuple(dict.fromkeys(spans)), quoted)

    done: dict[int | None, Literal | None] = {None: None}
    started: set[int] = set()
    for first in range(len(found)):
        stack = [first]
        while stack:
            k = stack[-1]
            if k in done:
                stack.pop()
                continue
            waiting = [] if k in started else [m for p in found[k].value if isinstance(p, Reference) and (m := meant(p, k)) not in done and m not in started]
            started.add(k)
            if waiting:
                stack += waiting
            else:
                done[k] = joined(k)
                stack.pop()
        if done[first]:
            yield found[first].name, done[first]
