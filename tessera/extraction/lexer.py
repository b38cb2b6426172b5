"""Tokens of brace languages with lines, matched brackets and the innermost declaration around a token."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
STRING = {
    "go": r"`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "java": r"\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "rust": r"b?r(?P<hashes>#*)\"[\s\S]*?\"(?P=hashes)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^\n]*?|[^'\\\n])'",
    "script": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
}
REST = r"(?P<id>[A-Za-z_$@#]?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*|[A-Za-z_$])|(?P<num>\d[\w.]*)|(?P<p>=>|::|->|\.\.\.|\?\.|:=|\S)"
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
PART = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(?:`|\$\{)")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class BadSource(Exception):
    """A text that cannot be read as its language."""


@dataclass
class Token:
    kind: str
    text: str
    line: int
    end: int


@dataclass
class Decl:
    name: str
    kind: str
    start: int
    end: int
    exported: bool
    owner: str | None = None
    test: bool = False
    lo: int = 0
    hi: int = -1


@dataclass
class Site:
    """An import; keys and ext are (priority, key), of which the lowest priority that exists wins."""

    specifier: str
    line: int
    end: int
    keys: list = field(default_factory=list)
    ext: list = field(default_factory=list)
    re_export: bool = False
    edge: bool = True
    names: dict = field(default_factory=dict)
    test: bool = False


@dataclass
class Call:
    caller: int
    name: str
    kind: str
    line: int
    end: int
    owner: str | None = None
    via: list = field(default_factory=list)
    own: bool = False
    strict: bool = False


@dataclass
class Parsed:
    decls: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    links: list = field(default_factory=list)
    provides: list = field(default_factory=list)


class Tokens:
    def __init__(self, text: str, language: str):
        pattern = re.compile(f"(?P<ws>\\s+)|(?P<c>{COMMENT})|(?P<str>{STRING[language]})|" + (r"(?P<life>'\w+)|" if language == "rust" else "") + REST)
        self.t: list[Token] = []
        at, line = 0, 1
        holes: list[int] = []  # open braces within each ${...} of a template, whose parts count as brackets
        while at < len(text):
            m = None
            ends_hole = bool(holes) and holes[-1] == 0 and text[at] == "}"
            if language == "script" and (text[at] == "`" or ends_hole):
                if ends_hole:
                    holes.pop()
                    self.t.append(Token("p", ")", line, line))
                m = PART.match(text, at + 1)
                if m is None:
                    raise BadSource("open template")
                end = line + m.group().count("\n")
                self.t.append(Token("str", m.group(), line, end))
                if m.group().endswith("${"):
                    holes.append(0)
                    self.t.append(Token("p", "(", end, end))
                at, line = m.end(), end
                continue
            if language == "script" and text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*"):
                last = self.t[-1] if self.t else None
                if last is None or (last.kind == "p" and last.text not in CLOSE) or last.text in ("return", "typeof", "case"):
                    m = REGEX.match(text, at)
            kind = "str" if m else None
            m = m or pattern.match(text, at)
            kind = kind or m.lastgroup
            if kind == "hashes":
                kind = "str"
            got = m.group()
            end = line + got.count("\n")
            if kind == "p" and language != "script" and got in "\"`" + ("" if language == "rust" else "'"):  # quotes in markup are no strings
                raise BadSource("open string")
            if holes and kind == "p" and got in "{}":
                holes[-1] += 1 if got == "{" else -1
            if kind not in ("ws", "c"):
                self.t.append(Token(kind, got, line, end))
            at, line = m.end(), end
        self.match: dict[int, int] = {}
        stack = []
        for i, k in enumerate(self.t):
            if k.kind != "p":
                continue
            if k.text in OPEN:
                stack.append(i)
            elif k.text in CLOSE:
                if not stack or OPEN[self.t[stack[-1]].text] != k.text:
                    raise BadSource("brackets")
                j = stack.pop()
                self.match[i], self.match[j] = j, i
        if stack:
            raise BadSource("brackets")

    def __len__(self):
        return len(self.t)

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind != "str" else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "id"

    def after(self, i: int) -> int:
        """The token after i, or after the bracket that i opens."""
        return self.match[i] + 1 if self.text(i) in OPEN else i + 1

    def angle(self, i: int) -> int:
        """The token after a type argument list that may begin at i."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self):
            depth += {"<": 1, ">": -1}.get(self.text(i), 0)
            i = self.after(i)
            if depth == 0:
                return i
        return i

    def find(self, i: int, wanted: set, stop: set = frozenset()) -> int:
        """The first wanted token from i on this level, or -1 at one of stop."""
        while i < len(self):
            if self.text(i) in wanted:
                return i
            if self.text(i) in stop or self.text(i) in CLOSE:
                return -1
            i = self.after(i)
        return -1

    def chain_start(self, i: int) -> int:
        """The first token of the chain of members of which i is the last name."""
        while self.text(i - 1) in (".", "?.", "::"):
            j = i - 2
            while self.text(j) in (")", "]"):
                j = self.match[j] - 1
            if not self.is_id(j):
                return max(j + 1, 0)
            i = j
        return i


def innermost(decls: list[Decl], i: int) -> int:
    """Index of the smallest declaration around token i; of equals the last; -1 without one."""
    best, size = -1, None
    for k, d in enumerate(decls):
        if d.lo <= i < d.hi and (size is None or d.hi - d.lo <= size):
            best, size = k, d.hi - d.lo
    return best
