import pytest
from codeloom.chunking.files import chunks_of, label, rows_of, skipped
from codeloom.chunking.rules import load_rules
from codeloom.chunking.units import LIMIT, hard_split
from codeloom.operators.chunks import cuts
from hypothesis import given, settings
from hypothesis import strategies as st


@given(st.text(alphabet="ab\n é", max_size=4000))
@settings(max_examples=50, deadline=None)
def test_cuts_cover_the_text(text):
    found = cuts(text)
    assert "".join(text[a:b] for a, b in found) == text
    assert all(0 < b - a <= 800 for a, b in found)


def test_cut_after_a_late_newline_only():
    assert cuts("a" * 500 + "\n" + "b" * 500)[0] == (0, 501)
    assert cuts("a" * 300 + "\n" + "b" * 700)[0] == (0, 800)
    assert hard_split(b"x" * 1700, 0, 1700) == [(0, 800), (800, 1600), (1600, 1700)]


def test_python_units_and_captures():
    body = "\n".join(f"        value_{i} = compute({i})" for i in range(40))
    source = f"import os\n\n# about it\n@app.get('/x')\nasync def small():\n    return 1\n\nclass TestBig:\n    def __init__(self):\n        pass\n\n    def work(self):\n{body}\n\nif __name__ == '__main__':\n    small()\n".encode()
    chunks, captures = chunks_of(source, "python")
    assert {(c.category, c.value) for c in captures} >= {("role", "api_endpoint"), ("type", "class"), ("role", "test_suite"), ("role", "entry_point")}
    assert "".join(source[c.start : c.end].decode() for c in chunks).replace("\n", "").replace(" ", "") == source.decode().replace("\n", "").replace(" ", "")
    small = next(c for c in chunks if b"async def small" in source[c.start : c.end])
    assert b"# about it" in source[small.start : small.end] and small.tags == ["async", "decorated"]
    assert any(c.parent is not None for c in chunks) and all(c.end - c.start <= LIMIT + 480 for c in chunks)


def test_brace_languages():
    source = b"import x from 'y';\n// note\nexport class A {\n  static make() { return '}'; }\n}\nconst f = (a) => { return a; };\ndescribe('it', () => { it('works', () => {}); });\napp.get('/p', handler);\n"
    chunks, captures = chunks_of(source, "javascript")
    assert ("role", "test_suite") in {(c.category, c.value) for c in captures} and ("role", "api_endpoint") in {(c.category, c.value) for c in captures}
    a = next(c for c in chunks if b"class A" in source[c.start : c.end])
    assert source[a.start : a.end].strip() == b"// note\nexport class A {\n  static make() { return '}'; }\n}" and "exported" in a.tags


def test_skipped_files_and_labels():
    assert skipped(b"a\0b") == "Binary file detected"
    assert skipped(b"x" * 1001) == "Minified"
    assert skipped(b"// generated by tool\n") == "Generated"
    assert skipped(b"ok\n") is None
    assert (label("entry_point"), label("function"), label("custom")) == ("Application Entry Point", "Function Definition", "Custom")
    assert rows_of("a.txt", b"x", 1, None) == []
    assert rows_of("bad.py", b"def (:\n  x\n", 11, None)[0]["status"] == "success"
    assert rows_of("empty.py", b"", 0, None)[0]["status"] == "success"


def test_rules_from_files(tmp_path):
    (tmp_path / "python.json").write_text('[{"pattern": "TODO", "capture": "note.todo"}, {"pattern": "x", "capture": "helper"}]')
    (tmp_path / "go.json").write_text('[{"pattern": "func (Test\\\\w+)", "capture": "role.test_case"}]')
    rules = load_rules(str(tmp_path))
    assert {k: [r[1:] for r in v] for k, v in rules.items()} == {"python": [("note", "todo")], "go": [("role", "test_case")]}
    assert ("note", "todo") in {(c.category, c.value) for c in chunks_of(b"x = 1  # TODO\n", "python", rules)[1]}
    assert ("role", "test_case") in {(c.category, c.value) for c in chunks_of(b"func TestA(t) {\n}\n", "go", rules)[1]}
    (tmp_path / "go.json").write_text('[{"pattern": "(", "capture": "role.x"}]')
    with pytest.raises(ValueError, match="go.json"):
        load_rules(str(tmp_path))


def test_captures_of_short_names_and_nested_definitions():
    """A name that is part of its keyword, and definitions below if, try and with."""
    source = b"class c:\n    def d(self):\n        pass\nif x:\n    class s: pass\ntry:\n    def e(): pass\nexcept E:\n    with y:\n        async def f(): pass\n"
    names = [(source[c.start : c.end], c.value) for c in chunks_of(source, "python")[1]]
    assert sorted(names) == [(b"c", "class"), (b"d", "function"), (b"e", "function"), (b"f", "function"), (b"s", "class")]
    assert [c.start for c in chunks_of(b"def d(): pass\n", "python")[1]] == [4]
