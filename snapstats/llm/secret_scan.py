"""Secrets in text: three fixed patterns, and literals that source or configuration assigns to sensitive names.

A lexer cuts the lines that assign something into names, strings of all quote forms (prefixed, triple, raw),
values without quotes, numbers and operators. A parser over these tokens yields (name, parts) pairs: a part is a
literal with its place, or a reference to a name. It knows ``name = "x"``, ``name: x``, ``"name": "x"``,
``name => x``, type annotations, subscripts, several targets (``a, b = "x", "y"``), concatenations with and
without an operator, formatted strings (their fixed parts), calls that name what they hold
(``define('NAME', 'x')``, ``getenv("NAME", "x")``, ``setName("x")``), lists of literals, alternatives behind ``or``,
``??`` and ``if .. else``, values continued on the next line, here-documents, ``IDENTIFIED BY 'x'``, XML elements and
attributes, and YAML block scalars. The password of a URL and the credential of an authorization header count as
assigned to those names.

A name that is bound to literals is a constant, and a later assignment from it passes the literals on, so a
literal first bound to a harmless name is scored by the sensitive name it reaches. The score of a literal is
the weight of the name (credential words in its parts) plus points for length, mixed character classes and
entropy; placeholders and dictionary-like values lose points. A concatenation, of constants too, is scored as a whole.

The time is linear in the text, whatever it holds: a list of names is read once, and a quote that nothing closes is
looked for once a line. Texts are scanned whole, one at a time; nothing is shuffled. Null text: no secrets. Empty text: no
secrets. Repeated rows each get their own result. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from snapstats.llm.common import arrow, few_rows, frame

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")

#: The words that make a name sensitive, and how much. They are matched on the parts of a name.
SENSITIVE = {
    "password": 4, "passwd": 4, "passphrase": 4, "pwd": 4, "secret": 4, "token": 3, "apikey": 4, "credential": 4,
    "credentials": 4, "privatekey": 4, "accesskey": 4, "secretkey": 4, "auth": 2, "authorization": 3, "bearer": 3,
    "signature": 1, "key": 1, "private": 1, "access": 1, "api": 1, "client": 1, "session": 1, "salt": 1,
}
#: Literals that stand for a secret rather than being one.
PLACEHOLDER = re.compile(r"(?ai)^(?:x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|your[_-].*|change[_-]?me|example.*|placeholder|none|null|true|false|todo|redacted|dummy|test)$")
LEAST_SCORE = 6
LEAST_LENGTH = 8
#: What constants give together is followed up to so many characters.
LONGEST = 4096

# possessive, and only from a name's first letter: a text without blanks is still read in one go
_NAME = r"(?<![\w$])[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+"
_NEXT = rf"""(?!["']?{_NAME}["']?[ \t]*[:=])"""
#: Tokens, the first that fits: strings with their prefix, names, numbers, operators; anything else is one character.
_OPEN = re.compile(r"""(?P<prefix>\b[rbufRBUF]{1,2}|@)?(?P<quote>\"\"\"|\'\'\'|["'`])""")
_BODY = {
    quote: re.compile(body, re.DOTALL)
    for quote, body in {
        '"""': r"""(?:[^"\\]|\\.|"(?!""))*+""", "'''": r"""(?:[^'\\]|\\.|'(?!''))*+""", '"': r"""(?:[^"\\\n]|\\.)*+""", "'": r"""(?:[^'\\\n]|\\.)*+""", "`": r"[^`\n]*+"
    }.items()
}
_ONE_NAME = re.compile(_NAME, re.ASCII)
_NUMBER = re.compile(r"[0-9][0-9_]*+(?![\w.])", re.ASCII)
_OPERATOR = re.compile(r":=|=>|->|[=!<>]=|::|\|\||\.\.|</|/>|.", re.DOTALL)
_BLANKS = re.compile(r"[ \t]*+")
# a value without quotes ends at a blank, comma, semicolon, quote or closing bracket, and where the next assignment begins
_BARE = re.compile(
    rf"""(?![(\[<&]|\{{(?!\{{))(?:\$\{{[^{{}}\s]*+\}}|\{{\{{[^{{}}\n]*+\}}\}}|[&?(\[]{_NEXT}|\{{{_NEXT}|<(?!/)|\+(?!["'`])|[^\s"'`,;&?<>()\[\]{{}}+])++""", re.ASCII
)
_CALL = re.compile(rf"{_NAME}[(\[]", re.ASCII)
_BETWEEN = re.compile(r"\+|\.\.|\|\|")
_FIELD = re.compile(r"\{([^{}]*)\}")
_TYPE = re.compile(r"[ \t]*[A-Za-z_][\w.]*(?:[ \t]*[\[<][\w.,|?\[\]<> \t]*[\]>])?[?!]?(?:[ \t]*\|[ \t]*[A-Za-z_][\w.]*)*[ \t]*(?==(?!=))", re.ASCII)
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[+-]?[ \t]*\n")
_TAG = re.compile(rf"<({_NAME})>([^<>\s]+)</\1>", re.ASCII)
#: Attributes that name what an element holds, and those that hold it.
_NAMED_BY, _HELD_BY = {"key", "name", "id", "property"}, {"value", "content", "default", "val"}
#: The password of a URL; what stands before a quoted password in SQL; the scheme before a credential.
_URL = re.compile(r"""://[^\s:/@"'<>]*:([^\s/@"'<>]+)@""")
_SQL = re.compile(r"""(?ai)\b(?:identified(?:[ \t]+with[ \t]+\w+)?[ \t]+(?:by|as)|with[ \t]+(?:encrypted[ \t]+)?password)[ \t]+(?=["'])""")
_SCHEME = re.compile(r"(?ai)(?:bearer|basic|token)[ \t]+(?=\S)")
_SETTER = re.compile(r"(?:^|\.)(?:set|with|put)(?=[_A-Z])")
_OTHERWISE = re.compile(r"\)?[ \t]*(?:or\b|\?\?)[ \t]*")
_TAG_LINE = re.compile(r"^[ \t]*([A-Za-z_]\w*)[ \t]*$", re.ASCII | re.MULTILINE)
_LINE = re.compile(r"\S(?:[^\n]*\S)?")
_HERE = re.compile(r"""<<[~-]?(["']?)([A-Za-z_]\w*)\1[^\n]*\n""", re.ASCII)
#: What any line has that assigns something.
_MAY_ASSIGN = re.compile(r"""=|:|</|\(\s*["']""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)


@dataclass
class Pair:
    """An assignment: literals and values without quotes, which may be names, as (start, end, value)."""

    name: str
    literals: list[tuple[int, int, str]] = field(default_factory=list)
    bare: list[tuple[int, int, str]] = field(default_factory=list)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, in code points."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


@dataclass
class String:
    """A string token: prefix, quotes, where its value begins, the value, and where the token ends."""

    prefix: str
    quote: str
    begin: int
    value: str
    stop: int

    def name(self) -> str | None:
        """The value, if it is a name."""
        return self.value if self.quote in "\"'" and _ONE_NAME.fullmatch(self.value) else None


def _string_parts(m: String) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The literals of a string token, and the names in the fields of a formatted one."""
    begin, value = m.begin, m.value
    if "f" not in m.prefix.lower() or "{" not in value:
        skip = scheme.end() if (scheme := _SCHEME.match(value)) else 0
        return [(begin + skip, begin + len(value), value[skip:])], []
    literals, names, at = [], [], 0
    for x in _FIELD.finditer(value):
        if at < x.start():
            literals.append((begin + at, begin + x.start(), value[at : x.start()]))
        names.append((begin + x.start(1), begin + x.end(1), x[1]))
        at = x.end()
    if at < len(value):
        literals.append((begin + at, begin + len(value), value[at:]))
    return literals, names


class _Parser:
    """Assignments over the tokens of a text, from one line that may have some to the next."""

    def __init__(self, text: str):
        self.text, self.n, self.found = text, len(text), []
        self.held: list[tuple[int, int, str]] = []
        #: Up to where nothing closes a quote, and where no ``else`` follows.
        self.unclosed: dict[str, int] = {}
        self.no_else = -1
        #: Lines that are a name alone, which may end a here-document.
        self.tags: dict[str, list[int]] | None = None

    def string(self, at: int) -> String | None:
        """The string token at ``at``.

        A quote behind which none closes leaves none that closes for any later one before that place, either: each
        of those opens where the first one's search stood, with the same escapes ahead.
        """
        if not (m := _OPEN.match(self.text, at)):
            return None
        quote, begin = m["quote"], m.end()
        for q in (quote, quote[0]) if len(quote) == 3 else (quote,):
            begin = m.start("quote") + len(q)
            if begin <= self.unclosed.get(q, -1):
                continue
            end = _BODY[q].match(self.text, begin).end()
            if self.text.startswith(q, end):
                return String(m["prefix"] or "", q, begin, self.text[begin:end], end + len(q))
            self.unclosed[q] = end
        return None

    def blanks(self, at: int) -> int:
        return _BLANKS.match(self.text, at).end()

    def add(self, name: str, literals: list, bare: list, at: int) -> None:
        if literals or bare:
            self.found.append((at, Pair(name, list(literals), list(bare))))

    def name_at(self, at: int) -> tuple[str, int] | None:
        """A name, or a string that is one, with what is subscripted to it: the name and where it ends."""
        text = self.text
        if m := _ONE_NAME.match(text, at):
            name, at = m[0], m.end()
        elif text[at : at + 1] in ('"', "'") and (s := self.string(at)) and (body := s.name()):
            name, at = body, s.stop
        else:
            return None
        while text[at : at + 1] == "[":
            if s := self.string(at + 1):
                part, end = s.value, s.stop
            elif m := _ONE_NAME.match(text, at + 1):
                part, end = m[0], m.end()
            else:
                break
            if text[end : end + 1] != "]":
                break
            name, at = f"{name}.{part}", end + 1
        return name, at

    def assigns(self, at: int) -> bool:
        """Whether the next assignment begins here, as in "a: b: c"; the = that pads base64 begins none."""
        if self.text[at : at + 1] in ("'", '"'):
            return False
        named = self.name_at(at)
        end = named and self.operator(self.blanks(named[1]))
        return bool(end) and end < self.n and self.text[end] not in "\r\n,;)]}"

    def operator(self, at: int) -> int | None:
        """Where an assigning operator ends, with the blanks behind it."""
        op = _OPERATOR.match(self.text, at)
        return self.blanks(op.end()) if op and op[0] in ("=", ":", ":=", "=>") else None

    def value(self, at: int, argument: bool = False) -> tuple[list, list, int]:
        """(literals, values without quotes, end) of one value: parts that are concatenated. A call in an argument is left to be read on its own."""
        text, literals, bare = self.text, [], []
        while at < self.n and not self.assigns(at):
            if s := self.string(at):
                own, names = _string_parts(s)
                literals += own
                bare += names
                at = s.stop
            elif (m := _ONE_NAME.match(text, at)) and text[m.end() : m.end() + 1] == "(":
                if argument:
                    break
                end = self.call(m[0], at, m.end())
                bare.append((at, m.end() + 1, m[0] + "("))
                if own := [x for x in self.held if x[0] > at]:
                    literals += own
                at = end
                break
            elif m := _BARE.match(text, at):
                if (scheme := _SCHEME.match(text, at)) and scheme.end() > m.end() and _BARE.match(text, scheme.end()):
                    at = scheme.end()
                    continue
                if m[0].endswith("\\") and text.startswith("\n", m.end()):  # goes on in the next line
                    literals.append((at, m.end() - 1, m[0][:-1]))
                    at = self.blanks(m.end() + 1)
                    if (m := _BARE.match(text, at)) and not m[0].endswith("\\"):
                        literals.append((at, m.end(), m[0]))
                        at = m.end()
                        break
                    continue
                bare.append((at, m.end(), m[0]))
                at = m.end()
            else:
                break
            after = self.blanks(at)
            op = _OPERATOR.match(text, after)
            if op and op[0] in ("+", "..", "||"):
                after = self.blanks(op.end())
                if text[after : after + 1] in "\"'`" or _ONE_NAME.match(text, after):
                    at = after
                    continue
            elif literals and self.string(after):  # strings beside each other are one
                at = after
                continue
            break
        return literals, bare, at

    def call(self, name: str, at: int, bracket: int) -> int:
        """A call whose first argument names what the second holds; ``held`` has that. Returns where to read on."""
        self.held, first = [], self.blanks(bracket + 1)
        if not (s := self.string(first)):
            return bracket + 1
        comma = self.blanks(s.stop)
        if self.text[comma : comma + 1] == ")" and _SETTER.search(name):
            self.add(name, _string_parts(s)[0], [], at)
            return s.stop
        if not (key := s.name()):
            return bracket + 1
        if self.text[comma : comma + 1] != ",":
            return s.stop
        literals, bare, end = self.value(self.blanks(comma + 1), argument=True)
        self.held = literals
        self.add(key, literals, bare if not literals else [], at)
        return end

    def block(self, name: str, at: int, end: int) -> int:
        """The lines of a YAML block scalar: those that are indented deeper than the line that begins it."""
        text = self.text
        line = text.rfind("\n", 0, at) + 1
        indent, literals = self.blanks(line) - line, []
        while end < self.n:
            stop = text.find("\n", end)
            stop = self.n if stop < 0 else stop
            begin = self.blanks(end)
            if begin < stop and begin - end <= indent:
                break
            if (body := text[begin:stop].rstrip()) :
                literals.append((begin, begin + len(body), body))
            end = stop + 1
        self.add(name, literals, [], at)
        return min(end, self.n)

    def element(self, at: int) -> int:
        """The attributes of an XML element: each is an assignment, and one may name what another holds."""
        end, named, held = at, None, []
        while m := _ONE_NAME.match(self.text, self.blanks(end)):
            begin, after = m.start(), self.blanks(m.end())
            if self.text[after : after + 1] != "=" or not (x := self.string(self.blanks(after + 1))):
                break
            literals, _ = _string_parts(x)
            self.add(m[0], literals, [], begin)
            if m[0].lower() in _NAMED_BY:
                named = literals[0][2]
            elif m[0].lower() in _HELD_BY:
                held = literals
            end = x.stop
        if named and held:
            self.add(named, held, [], at)
        return end

    def targets(self, at: int) -> int:
        """An assignment that begins with the name at ``at``; returns where to read on."""
        text, names, end, last = self.text, [], at, at
        while named := self.name_at(end):
            last = end
            names.append(named[0])
            end = self.blanks(named[1])
            if text[end : end + 1] != ",":
                break
            end = self.blanks(end + 1)
        if not names:
            return at + 1
        if named and text[end : end + 1] == "(" and end == named[1]:
            return max(self.call(names[-1], last, end), end + 1)
        begin = self.operator(end) if named else None
        if begin is None:  # none of the list is assigned to: read on behind it
            return named[1] if named else end
        if text[end] == ":":
            if m := _BLOCK.match(text, begin):
                return self.block(names[-1], at, m.end())
            if (m := _TYPE.match(text, begin)) and not self.assigns_to_type(m):
                begin = self.operator(m.end())
        if len(names) == 1:
            if m := _HERE.match(text, begin):
                return self.here(names[0], at, m)
            if text[begin : begin + 1] in ("[", "(", "{") and (stop := self.listed(names[0], begin, at)):
                return stop
            literals, bare, stop = self.value(begin)
            self.add(names[0], literals, bare, at)
            while after := self.otherwise(stop):
                literals, bare, stop = self.value(after)
                self.add(names[0], literals, bare, at)
                stop = max(stop, after)
            return max(stop, begin)
        values = []
        while len(values) < len(names):
            literals, bare, begin = self.value(begin)
            values.append((literals, bare))
            begin = self.blanks(begin)
            if text[begin : begin + 1] != ",":
                break
            begin = self.blanks(begin + 1)
        for name, (literals, bare) in zip(names[-len(values) :], values):  # of fewer values the last is that of the last name
            self.add(name, literals, bare, at)
        return begin

    def otherwise(self, at: int) -> int | None:
        """Where the other of two values begins: behind ``or``, ``??`` or ``if .. else``."""
        if m := _OTHERWISE.match(self.text, at):
            return m.end()
        begin = self.blanks(at)
        if begin > at and self.text.startswith("if ", begin) and begin > self.no_else:
            stop = self.text.find("\n", begin)
            stop = self.n if stop < 0 else stop
            found = self.text.find(" else ", begin, stop)
            if found >= 0:
                return self.blanks(found + 6)
            self.no_else = stop
        return None

    def listed(self, name: str, at: int, target: int) -> int | None:
        """A list of strings: each is assigned to the name. None if the first is no string."""
        text, end, some = self.text, at + 1, False
        while end < self.n:
            while text[end : end + 1] in (" ", "\t", "\n", "\r"):
                end += 1
            if not (s := self.string(end)) or s.name() and self.operator(self.blanks(s.stop)):  # the latter is an object's first name
                break
            self.add(name, _string_parts(s)[0], [], target)
            some, end = True, self.blanks(s.stop)
            if text[end : end + 1] != ",":
                break
            end += 1
        return end if some else None

    def here(self, name: str, at: int, m: re.Match) -> int:
        """The lines of a here-document up to its tag."""
        if self.tags is None:
            self.tags = {}
            for x in _TAG_LINE.finditer(self.text):
                self.tags.setdefault(x[1], []).append(x.start(1))
        lines = self.tags.get(m[2], [])
        if (k := bisect_left(lines, m.end())) == len(lines):
            return m.end()
        body = _LINE.finditer(self.text, m.end(), self.text.rfind("\n", 0, lines[k]))
        self.add(name, [(x.start(), x.end(), x[0]) for x in body], [], at)
        return lines[k]

    def assigns_to_type(self, m: re.Match) -> bool:
        """Whether what looks like a type is a sensitive name itself, as in "note: password = x"."""
        return name_weight(m[0].strip()) > 1

    def pairs(self) -> list[Pair]:
        text = self.text
        for m in _TAG.finditer(text):
            self.found.append((m.start(), Pair(m[1], [(m.start(2), m.end(2), m[2])])))
        for m in _URL.finditer(text):
            self.found.append((m.start(), Pair("password", [(m.start(1), m.end(1), m[1])])))
        for m in _SQL.finditer(text):
            if s := self.string(m.end()):
                self.found.append((m.start(), Pair("password", _string_parts(s)[0])))
        self.unclosed.clear()
        at = 0
        while m := _MAY_ASSIGN.search(text, at):
            line = max(at, text.rfind("\n", at, m.start()) + 1)
            stop = text.find("\n", m.end())
            at = self.line(line, self.n if stop < 0 else stop)
        self.found.sort(key=lambda x: x[0])
        return [p for _, p in self.found]

    def line(self, at: int, stop: int) -> int:
        """All assignments from ``at``; one that runs over the line's end takes ``at`` with it."""
        text = self.text
        while at < stop:
            c = text[at]
            if c == "<" and (m := _ONE_NAME.match(text, at + 1)):
                at = self.element(m.end())
            elif c in "\"'" or c == "$" or c == "_" or (c.isascii() and c.isalpha()):
                before = at
                if self.name_at(at):
                    at = self.targets(at)
                elif (at == 0 or not text[at - 1].isalnum()) and (s := self.string(at)):  # not the apostrophe of a word
                    at = s.stop
                else:
                    m = _ONE_NAME.match(text, at)
                    at = m.end() if m else at + 1
                at = max(at, before + 1)
            else:
                at += 1
        return at


def pairs(text: str) -> list[Pair]:
    """The name-literal pairs of a text, in order."""
    return _Parser(text).pairs()


def _resolved(pair: Pair, bound: dict[str, int]) -> list[tuple[int, int]]:
    """Places and nodes that the values without quotes refer to; a value that is no bound name becomes a literal.

    A single name that is not bound is code from elsewhere, unless it has a digit; so is a call.
    """
    refers = []
    for start, end, value in pair.bare:
        names = _BETWEEN.split(value)
        if all(n in bound for n in names):
            refers += [(start, bound[n]) for n in names]
        elif not _CALL.match(value) and (any(c.isdigit() for c in value) or not all(_ONE_NAME.fullmatch(n) for n in names)):
            pair.literals.append((start, end, value))
    return refers


@lru_cache(4096)
def name_weight(name: str) -> int:
    """By the words of the name: camel case, snake case, dots and hyphens separate them; two neighbours count joined, too."""
    words = [w.lower() for w in _WORDS.findall(name)]
    words = [w[:-1] if w not in SENSITIVE and w.endswith("s") else w for w in words]
    return max([0, *(SENSITIVE.get(w, 0) for w in words), *(SENSITIVE.get(a + b, 0) for a, b in zip(words, words[1:]))])


def literal_points(value: str) -> int:
    """Up to 4 points: length, character classes and entropy; -9 for what can't be a secret."""
    if len(value) < LEAST_LENGTH or any(c.isspace() for c in value) or PLACEHOLDER.match(value):
        return -9
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    if value.isdigit():  # a number that is no year, count or round figure
        return 2 * (n >= 10 and entropy >= 2.3)
    return (n >= 12) + (classes >= 2) + (classes >= 3) + (entropy >= 3) - 2 * (classes == 1)


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, each once."""
    if not _MAY_ASSIGN.search(text) and not _SQL.search(text):
        return []
    # each assignment is a node; it refers to the nodes its names were bound to when it was read
    nodes: list[tuple[Pair, list[int]]] = []
    built: list[tuple[str, list[tuple[int, int]]] | None] = []  # what a node's parts give together, where it refers to some
    bound: dict[str, int] = {}
    by_weight: dict[int, list[int]] = {}
    for pair in pairs(text):
        refers = _resolved(pair, bound)
        if pair.literals or refers:
            bound[pair.name] = len(nodes)
            by_weight.setdefault(name_weight(pair.name), []).append(len(nodes))
            built.append(_built(pair, refers, built))
            nodes.append((pair, [node for _, node in refers]))
    seen: set[int] = set()
    out: dict[tuple[int, int], None] = {}
    for weight in sorted((w for w in by_weight if w), reverse=True):  # what a node passes on counts for the most sensitive name it reaches
        todo = by_weight[weight]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                pair, refers = nodes[at]
                todo += refers
                whole = "".join(value for _, _, value in pair.literals)
                if len(refers) + len(pair.literals) > 1 and built[at] and weight + literal_points(built[at][0]) >= LEAST_SCORE:
                    out.update((span, None) for span in built[at][1])
                if weight + literal_points(whole) >= LEAST_SCORE:
                    out.update(((start, end), None) for start, end, value in pair.literals if value)
    return [(start, end, "literal") for start, end in out]


def _built(pair: Pair, refers: list[tuple[int, int]], built: list) -> tuple[str, list[tuple[int, int]]] | None:
    """The value of a node and the literals in it, in order; None where it is longer than any credential."""
    parts = [(start, value, [(start, end)]) for start, end, value in pair.literals if value]
    for start, node in refers:
        if built[node] is None:
            return None
        parts.append((start, *built[node]))
    if sum(len(value) for _, value, _ in parts) > LONGEST and refers:
        return None
    parts.sort(key=lambda x: x[0])
    return "".join(value for _, value, _ in parts), [span for *_, spans in parts for span in spans]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        counts, digests, spans = [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            every = base + literal_spans(text)
            kinds = Counter(k for _, _, k in every)
            counts.append([kinds[k] for k in KINDS])
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(every))
        columns = zip(*counts) if counts else [[]] * len(KINDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *(pa.array(list(c), pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: how many spans of each kind, a digest of the pattern spans, and all spans."""
    found = arrow(
        frame(docs, key=key, text=text), _scan, "key long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    )
    return found.withColumnRenamed("key", key)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal")
