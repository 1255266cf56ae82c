"""Units and captures of languages with braces, by a lexer that skips strings and comments."""

from __future__ import annotations

import re

from .units import Capture, Unit

_SKIP = re.compile(rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_CONTAINER = re.compile(rb"\b(?:class|interface|enum|struct|trait|impl|namespace|module|function|func|fn)\b|=>|\)\s*(?::\s*[\w<>\[\]., ]+)?\s*\Z")
_TAGS = {"async": rb"\basync\b", "exported": rb"^\s*export\b|^\s*pub\b", "static": rb"\bstatic\b", "constructor": rb"\bconstructor\s*\(", "decorated": rb"^\s*@\w"}
_RULES = [
    (rb"\b(?:describe|context|suite)\s*\(", "role", "test_suite"),
    (rb"\b(?:it|test|specify)\s*\(\s*['\"`]", "role", "test_case"),
    (rb"\b(?:app|router|server)\.(?:get|post|put|delete|patch|use)\s*\(", "role", "api_endpoint"),
    (rb"@(?:Controller|Get|Post|Put|Delete|Patch)\s*\(", "role", "api_endpoint"),
    (rb"\binterface\s+(\w+)", "role", "data_schema"),
    (rb"\btype\s+(\w+)\s*=", "role", "data_schema"),
    (rb"\bclass\s+(\w+)", "type", "class"),
    (rb"\b(?:function\*?|func|fn)\s+(\w+)", "type", "function"),
    (rb"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>", "type", "function"),
    (rb"\b(?:func|fn|void|int)\s+main\s*\(", "role", "entry_point"),
]


def blank(data: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The file with strings and comments blanked out, at the same length, and the bounds of comments."""
    comments = []

    def hide(m: re.Match) -> bytes:
        if m[0][:1] == b"/":
            comments.append(m.span())
        return re.sub(rb"[^\n]", b" ", m[0])

    return _SKIP.sub(hide, data), comments


def parse(data: bytes, rules: list[tuple[bytes, str, str]] | None = None) -> tuple[list[Unit], list[Capture]]:
    """The units of a file and its captures, by the built-in rules and ``rules``. Braces that don't match close at the end of the file."""
    code, comments = blank(data)
    partner: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(rb"[{}]", code):
        if m[0] == b"{":
            stack.append(m.start())
        elif stack:
            partner[stack.pop()] = m.start() + 1
    for a in stack:
        partner[a] = len(code)
    comment_at = dict(comments)

    def scope(start: int, end: int) -> list[Unit]:
        out: list[Unit] = []
        i = start
        while i < end:
            if i in comment_at:
                out.append(Unit(i, min(comment_at[i], end), glue=True))
                i = comment_at[i]
            elif code[i : i + 1].isspace() or code[i : i + 1] in (b";", b"}", b")", b","):
                if out and code[i : i + 1] in (b";", b")", b","):
                    out[-1].end = i + 1
                i += 1
            else:
                out.append(statement(i, end))
                i = out[-1].end
        return out

    def statement(start: int, end: int) -> Unit:
        depth = 0
        for m in re.finditer(rb"[;{\n()]", code[start:end]):
            at = start + m.start()
            c = m[0]
            if c in b"()":
                depth += 1 if c == b"(" else -1
            elif c == b";" and depth <= 0:
                return Unit(start, at + 1)
            elif c == b"\n" and depth <= 0 and code[start:at].strip() and not code[at:end].lstrip().startswith((b"{", b".")):
                if re.match(rb"\s*@\w", code[start:at]):
                    return Unit(start, at, glue=True)
                return Unit(start, at)
            elif c == b"{":
                stop = min(partner[at], end)
                head = code[start:at]
                if _CONTAINER.search(head):
                    u = Unit(start, stop, container=True, body_start=at + 1)
                    u.body = scope(at + 1, stop - 1)
                    u.tags = [t for t, r in _TAGS.items() if re.search(r, head)]
                    return u
                return Unit(start, stop)
        return Unit(start, end)

    captures = []
    for rule, category, value in [*_RULES, *(rules or [])]:
        for m in re.finditer(rule, data):
            group = 1 if m.re.groups else 0
            if code[m.start() : m.start() + 1].strip():  # not inside a comment or string
                captures.append(Capture(*m.span(group), category, value))
    return scope(0, len(code)), captures
