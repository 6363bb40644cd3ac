"""Chunks of TypeScript and JavaScript files: top-level functions, classes with their methods, interfaces.

A scanner cuts the text into tokens (comments, strings, templates and regular expressions are skipped as wholes); a
reader then walks the statements of the top level and the members of classes, keeping account of brackets.
Text whose brackets don't match is chunked by line rules instead.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunking import SCRIPT_RULES

_TOKEN = re.compile(
    r"""(?P<skip>[^\S\n]+|\n|//[^\n]*|/\*.*?\*/|\#![^\n]*)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)
    |(?P<number>\d[\w.]*)
    |(?P<sign>=>|\?\.|\.\.\.|[-+*/%&|^!=<>?]+=*|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "yield", "await"}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "async", "get", "set", "abstract", "override", "declare", "accessor"}


class Unreadable(ValueError):
    pass


class Token:
    __slots__ = ("at", "kind", "line", "mate", "text")

    def __init__(self, kind, text, line, at):
        self.kind, self.text, self.line, self.at, self.mate = kind, text, line, at, -1


_SKIPPED = re.compile(r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|//[^\n]*|/\*[\s\S]*?\*/""")


def _template_end(text: str, at: int) -> int:
    """The position after the template that begins at at, with what its ${} hold."""
    i, depth = at + 1, []
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if not depth or depth[-1] == "`":
            if c == "`":
                if not depth:
                    return i + 1
                depth.pop()
            elif text.startswith("${", i):
                depth.append("{")
                i += 1
        elif m := _SKIPPED.match(text, i):  # strings and comments between the braces
            i = m.end()
            continue
        elif c == "`":
            depth.append("`")
        elif c == "{":
            depth.append("{")
        elif c == "}":
            depth.pop()
        i += 1
    raise Unreadable("template")


def scan(text: str) -> list[Token]:
    out, at, line = [], 0, 1
    open_ = []
    while at < len(text):
        if text[at] == "`":
            end = _template_end(text, at)
            out.append(Token("string", text[at:end], line, at))
            line += text.count("\n", at, end)
            at = end
            continue
        if text[at] == "/" and not text.startswith(("//", "/*"), at):
            before = out[-1] if out else None
            if before is None or (before.kind == "sign" and before.text not in (")", "]", "}")) or before.text in _BEFORE_REGEX:
                m = _REGEX.match(text, at)
                if m and not (before is not None and before.text == "<"):
                    out.append(Token("string", m[0], line, at))
                    at = m.end()
                    continue
        m = _TOKEN.match(text, at)
        kind, found = m.lastgroup, m[0]
        if kind == "sign" and found[0] in "<>" and len(found) > 1:
            found = found[0]  # brackets of types are read one by one
        if kind != "skip":
            t = Token(kind, found, line, at)
            if found in _PAIRS:
                open_.append(len(out))
            elif found in (")", "]", "}"):
                if not open_ or _PAIRS[out[open_[-1]].text] != found:
                    raise Unreadable("brackets")
                out[open_[-1]].mate = len(out)
                t.mate = open_.pop()
            out.append(t)
        line += found.count("\n")
        at += len(found)
    if open_:
        raise Unreadable("brackets")
    return out


class Reader:
    def __init__(self, text: str):
        self.t = scan(text)
        self.found: list[tuple[str, str, int, int]] = []  # kind, name, first and last line

    def text(self, i: int) -> str:
        return self.t[i].text if i < len(self.t) else ""

    def past(self, i: int) -> int:
        """The token after token i and, if it opens a bracket, what it holds."""
        return (self.t[i].mate if self.t[i].text in _PAIRS else i) + 1

    def past_angles(self, i: int) -> int:
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            x = self.text(i)
            depth += (x == "<") - (x == ">")
            i = self.past(i)
            if depth == 0:
                return i
        raise Unreadable("types")

    def past_type(self, i: int, stop: set[str]) -> int:
        """After a type that begins at i; ends at a sign in stop, or at a { or line that can't go on it."""
        fresh = True
        while i < len(self.t):
            x = self.text(i)
            if not fresh and x in stop:
                return i
            if x == "{" and not fresh:
                return i
            if not fresh and self.t[i].line > self.t[i - 1].line and x not in ("|", "&", ".", "[", "=>", "extends", "is"):
                return i
            if x == "<":
                i = self.past_angles(i)
                fresh = False
                continue
            fresh = x in ("|", "&", "=>", "keyof", "typeof", "readonly", "is", "extends", "?", ":", "asserts", ".", "infer", "unique")
            i = self.past(i)
        return i

    def past_statement(self, i: int) -> int:
        """After a statement of no interest: at ; or where a line ends and the next can't go on it."""
        first = i
        while i < len(self.t):
            x = self.text(i)
            if x == ";":
                return i + 1
            if i > first and self.t[i].line > self.t[i - 1].line and self._ends(i):
                return i
            i = self.past(i)
        return i

    def _ends(self, i: int) -> bool:
        before, now = self.t[i - 1], self.t[i]
        if before.kind == "sign" and before.text not in (")", "]", "}", "++", "--", "!"):
            return False
        if before.text in _BEFORE_REGEX or before.text in ("extends", "implements", "from", "as", "instanceof", "=", "const", "let", "var", "default", "export", "async"):
            return False
        return not (now.kind == "sign" and now.text[0] not in "{}@#+-!(;[*" and now.text != "...") and now.text not in ("from", "as", "instanceof", "in", "of", "else", "catch", "finally", "while", "extends", "implements")

    def past_function(self, i: int) -> tuple[int, bool]:
        """From type parameters or ( of a function: after its body, and whether it has one."""
        i = self.past_angles(i)
        if self.text(i) != "(":
            raise Unreadable("function")
        i = self.past(i)
        if self.text(i) == ":":
            i = self.past_type(i + 1, {"{", ";", "}"})
        if self.text(i) == "{":
            return self.past(i), True
        return i + (self.text(i) == ";"), False

    def is_function(self, i: int) -> bool:
        """Whether the expression at i is an arrow or function expression."""
        if self.text(i) == "async" and self.text(i + 1) in ("function", "(", "<") or (self.text(i) == "async" and self.text(i + 2) == "=>"):
            i += 1
        if self.text(i) == "function":
            return True
        if i < len(self.t) and self.t[i].kind == "name" and self.text(i + 1) == "=>":
            return True
        i = self.past_angles(i) if self.text(i) == "<" else i
        if self.text(i) != "(":
            return False
        i = self.past(i)
        if self.text(i) == ":":
            j = self.past_type(i + 1, {"=>", ";", ",", ")"})
            return self.text(j) == "=>" or "=>" in (self.text(k) for k in range(i, j))
        return self.text(i) == "=>"

    def read(self) -> list[tuple[str, str, int, int]]:
        i = 0
        while i < len(self.t):
            i = max(self.statement(i), i + 1)
        return self.found

    def statement(self, i: int) -> int:
        begin = i
        while self.text(i) == "@":
            i = self.past(i + 1)
            while self.text(i) in (".", "("):
                i = self.past(i) if self.text(i) == "(" else i + 2
        default = False
        if self.text(i) == "export":
            i += 1
            if self.text(i) == "default":
                default = True
                i += 1
            begin = i
        start = i
        while self.text(i) in ("declare", "abstract") and i + 1 < len(self.t) and self.t[i + 1].kind == "name":
            i += 1
        x = self.text(i)
        if x == "async" and self.text(i + 1) == "function":
            i, x = i + 1, "function"
        if x == "function":
            return self.function(start, i + 1)
        if x == "class":
            return self.class_(min(begin, start), i + 1)
        if x == "interface" and self.t[i + 1].kind == "name":
            name = self.text(i + 1)
            while self.text(i) != "{":
                i = self.past_angles(i) if self.text(i) == "<" else self.past(i)
                if i >= len(self.t):
                    raise Unreadable("interface")
            self.add("interface", name, start, self.t[i].mate)
            return self.t[i].mate + 1
        if x in ("const", "let", "var") and not default and self.text(i + 1) != "enum":
            return self.variables(start, i + 1)
        return self.past_statement(i)

    def add(self, kind: str, name: str, first: int, last: int) -> None:
        end = self.t[last]
        self.found.append((kind, name, self.t[first].line, end.line + end.text.count("\n")))

    def function(self, start: int, i: int) -> int:
        i += self.text(i) == "*"
        name = "anonymous"
        if self.t[i].kind == "name":
            name, i = self.text(i), i + 1
        end, _ = self.past_function(i)
        self.add("function", name, start, end - 1)
        return end

    def class_(self, start: int, i: int) -> int:
        name = "AnonymousClass"
        if self.t[i].kind == "name" and self.text(i) not in ("extends", "implements"):
            name = self.text(i)
        while self.text(i) != "{":
            i = self.past_angles(i) if self.text(i) == "<" else self.past(i)
            if i >= len(self.t):
                raise Unreadable("class")
        self.add("class", name, start, self.t[i].mate)
        end = self.t[i].mate
        i += 1
        while i < end:
            i = self.member(name, i, end)
        return end + 1

    def member(self, owner: str, i: int, end: int) -> int:
        if self.text(i) == ";":
            return i + 1
        start = i
        while self.text(i) == "@":
            i = self.past(i + 1)
            while self.text(i) in (".", "("):
                i = self.past(i) if self.text(i) == "(" else i + 2
        abstract = False
        while self.text(i) in _MODIFIERS and self.text(i + 1) not in ("(", "=", ";", ":", "?", "!", "<", "}"):
            abstract |= self.text(i) == "abstract"
            i += 1
        i += self.text(i) == "*"
        if self.text(i) == "{":  # a static block
            return self.past(i)
        if self.text(i) == "#":
            i += 1
        t = self.t[i]
        if t.text == "[":
            key = self.text(i + 1) if t.mate == i + 2 and self.t[i + 1].kind in ("name",) else self.text(i + 1).strip("'\"") if t.mate == i + 2 else "unknown"
        else:
            key = t.text[1:-1] if t.kind == "string" else t.text
        i = self.past(i)
        i += self.text(i) in ("?", "!")
        if self.text(i) in ("(", "<"):
            after, body = self.past_function(i)
            if body and not abstract:
                self.add("method", f"{owner}.{key}", start, after - 1)
            return after
        value = -1
        while i < end:
            x = self.text(i)
            if x == ";":
                i += 1
                break
            if i > start and self.t[i].line > self.t[i - 1].line and self._ends(i) and x not in ("(", "["):
                break
            if x == "=" and value < 0:
                value = i + 1
            i = self.past(i)
        if value >= 0 and self.is_function(value):
            self.add("method", f"{owner}.{key}", start, i - 1)
        return i

    def variables(self, start: int, i: int) -> int:
        names, at_name = [], True
        first = i
        while i < len(self.t):
            x = self.text(i)
            if x == ";":
                i += 1
                break
            if i > first and self.t[i].line > self.t[i - 1].line and self._ends(i) and x not in ("(", "["):
                break
            if x == ",":
                at_name = True
                i += 1
                continue
            if at_name:
                name = x if self.t[i].kind == "name" else "anonymous"
                i = self.past(i)
                i += self.text(i) == "!"
                if self.text(i) == ":":
                    i = self.past_type(i + 1, {"=", ";", ","})
                if self.text(i) == "=" and self.is_function(i + 1):
                    names.append(name)
                at_name = False
                continue
            i = self.past_angles(i) if x == "<" and self.text(i - 1) == "=" else self.past(i)
        for name in names:
            self.add("function", name, start, i - 1)
        return i


def _by_rules(lines: list[str]) -> list[tuple[str, str, int, int]]:
    starts = []
    for n, line in enumerate(lines, 1):
        for pattern, kind, group in SCRIPT_RULES:
            if m := re.match(pattern, line):
                starts.append((kind, m[group], n))
                break
    ends = [s[2] - 1 for s in starts[1:]] + [len(lines)] * bool(starts)
    return [(k, name, n, e) for (k, name, n), e in zip(starts, ends, strict=True)]


def chunks_of(path: str, content: str) -> list[dict]:
    lines = content.split("\n")
    try:
        found, unique = Reader(content).read(), True
    except (Unreadable, IndexError, RecursionError):
        found, unique = _by_rules(lines), False
    if not found:
        return [{"id": f"{path}::module", "kind": "module", "name": None, "start_line": 1, "end_line": len(lines), "content": content, "ordinal": 1}]
    out, seen = [], set()
    for n, (kind, name, first, last) in enumerate(found, 1):
        own, k = f"{path}::{name}", 2
        while unique and own in seen:
            own, k = f"{path}::{name}__{k}", k + 1
        seen.add(own)
        out.append({"id": own, "kind": kind, "name": name, "start_line": first, "end_line": last, "content": "\n".join(lines[first - 1 : last]), "ordinal": n})
    return out


SLICE = 1 << 22


def chunks_by_syntax(files: DataFrame) -> DataFrame:
    """files (path, content): id, file_path, kind, name, start_line, end_line, content, ordinal."""
    names = ["id", "file_path", "kind", "name", "start_line", "end_line", "content", "ordinal"]
    types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string(), pa.int32()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for p, t in zip(batch.column(0), batch.column(1), strict=True):  # file by file, in slices of about SLICE characters
                if (t := t.as_py()) is not None:
                    rows += [c | {"file_path": p.as_py()} for c in chunks_of(p.as_py(), t)]
                    size += len(t)
                if size > SLICE:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, "id string, file_path string, kind string, name string, start_line int, end_line int, content string, ordinal int")
