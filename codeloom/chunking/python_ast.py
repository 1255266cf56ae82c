"""Units and captures of Python files by the standard library's ``ast``."""

from __future__ import annotations

import ast
import re

from .units import Capture, Unit

_DEFINED = ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef
_HTTP = {"get", "post", "put", "delete", "patch", "route", "websocket"}


class Lines:
    def __init__(self, data: bytes):
        self.data = data
        self.starts = [0]
        for line in data.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column


_KEYWORD = re.compile(rb"(?:async\s+)?(?:def|class)\s+")


def name_of(node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef, data: bytes, lines: Lines) -> tuple[int, int]:
    """The bytes of a definition's name, behind its keyword."""
    start = lines.at(node.lineno, node.col_offset)
    keyword = _KEYWORD.match(data, start)
    at = data.find(node.name.encode(), keyword.end() if keyword else start)
    return at, at + len(node.name.encode())


def _dotted(node: ast.expr) -> str:
    node = node.func if isinstance(node, ast.Call) else node
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


def parse(data: bytes, rules: list[tuple[bytes, str, str]] | None = None) -> tuple[list[Unit], list[Capture]]:
    """The units of a module and its captures, by the built-in rules and ``rules``; ``SyntaxError`` if it doesn't parse."""
    tree = ast.parse(data)
    lines = Lines(data)
    captures: list[Capture] = []

    def capture(node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        a, b = name_of(node, data, lines)
        decorators = [_dotted(d) for d in node.decorator_list]
        if isinstance(node, ast.ClassDef):
            captures.append(Capture(a, b, "type", "class"))
            bases = [_dotted(x) for x in node.bases]
            if node.name.startswith("Test") or any(x.endswith("TestCase") for x in bases):
                captures.append(Capture(a, b, "role", "test_suite"))
            if any(x.rpartition(".")[2] == "dataclass" for x in decorators) or any(x.endswith("BaseModel") for x in bases):
                captures.append(Capture(a, b, "role", "data_schema"))
        else:
            captures.append(Capture(a, b, "type", "function"))
            if node.name.startswith("test_"):
                captures.append(Capture(a, b, "role", "test_case"))
            if any("." in d and d.rpartition(".")[2] in _HTTP for d in decorators):
                captures.append(Capture(a, b, "role", "api_endpoint"))

    def unit(node: ast.stmt, inside: bool) -> Unit:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        start = lines.at(node.lineno, node.col_offset) if first == node.lineno else lines.starts[first - 1] + len(lines.data[lines.starts[first - 1] : lines.starts[first]]) - len(lines.data[lines.starts[first - 1] : lines.starts[first]].lstrip())
        end = lines.at(node.end_lineno, node.end_col_offset)
        u = Unit(start, end)
        for inner in () if isinstance(node, _DEFINED) else ast.walk(node):  # below if, try, with and loops
            if isinstance(inner, _DEFINED):
                capture(inner)
        if isinstance(node, _DEFINED):
            capture(node)
            u.container = True
            u.body = scope(node.body, isinstance(node, ast.ClassDef))
            u.body_start = u.body[0].start
            u.tags += ["async"] * isinstance(node, ast.AsyncFunctionDef) + ["decorated"] * bool(node.decorator_list)
            u.tags += ["constructor"] * (inside and node.name == "__init__") + ["static"] * any(_dotted(d) == "staticmethod" for d in node.decorator_list)
        elif isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            u.glue = True
        elif isinstance(node, ast.If) and isinstance(node.test, ast.Compare) and _dotted(node.test.left) == "__name__":
            captures.append(Capture(start, end, "role", "entry_point"))
        return u

    def scope(body: list[ast.stmt], inside: bool) -> list[Unit]:
        return [unit(n, inside) for n in body]

    units = scope(tree.body, False)
    captures += [Capture(*m.span(1 if m.re.groups else 0), category, value) for rule, category, value in rules or [] for m in re.finditer(rule, data)]
    return units, captures
