"""Scalar functions of the graph's model as Column expressions, all of which stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "rs": "rust", "c": "c", "cpp": "cpp", "rb": "ruby", "php": "php", "cs": "c_sharp"}
LABELS = {
    "entry_point": "Application Entry Point", "api_endpoint": "API Endpoint", "test_case": "Test Case", "test_suite": "Test Suite",
    "data_schema": "Data Schema", "class": "Class Definition", "function": "Function Definition",
}
PRUNED_DIRS = (".git", "node_modules", "__pycache__", ".venv", "dist", "build", "target", "vendor")
#: Files above this size, and files with a NUL in the first kilobyte, aren't parsed.
MAX_FILE_BYTES = 1 << 20


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def stable_id(*parts: Column) -> Column:
    """A deterministic id: the SHA-256 of the parts, joined by bars."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def extension(path: Column) -> Column:
    """What follows the last dot of the last segment, without the dot; empty if there is none."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column) -> Column:
    """The language of a path by its extension, ``unknown`` otherwise."""
    return F.coalesce(_lookup(extension(path), LANGUAGES), F.lit("unknown"))


def category_of(path: Column) -> Column:
    """``test`` by substring, else ``config`` or ``docs`` by extension, else ``code``."""
    p = F.lower(path)
    return F.when(p.rlike("test|spec"), "test").when(p.rlike(r"\.(json|yaml|yml|env|toml|xml)$"), "config").when(p.rlike(r"\.(md|txt|rst)$"), "docs").otherwise("code")


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"^(https?://|git@|ssh://)[^@]+@(.+)", "$1$2")


def normal_url(url: Column) -> Column:
    """Host and path of a repository's address in one spelling."""
    bare = F.regexp_replace(without_credentials(url), r"^(https?://|ssh://|git@)", "")
    return F.trim(F.translate(F.regexp_replace(bare, r"\.git$", ""), ":", "/"), F.lit("/"))


def repository_name(url: Column) -> Column:
    return F.regexp_replace(base_name(F.rtrim(url, F.lit("/"))), r"\.git$", "")


def cache_key(url: Column) -> Column:
    """The name of a repository's mirror."""
    return F.concat(F.sha2(url, 256), F.lit(".git"))


def loggable_url(url: Column) -> Column:
    return F.element_at(F.split(url, "@"), -1)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def label_of(value: Column) -> Column:
    """The label of a capture's value: a fixed one, or the words of the value with capitals."""
    return F.coalesce(_lookup(value, LABELS), F.initcap(F.replace(value, F.lit("_"), F.lit(" "))))


def primary_label(matches: Column) -> Column:
    """The label of the first role, else of the last type, else ``Code Block``."""
    named = lambda m: F.coalesce(F.when(m["label"] != "", m["label"]), m["value"])
    role = F.try_element_at(F.filter(matches, lambda m: m["category"] == "role"), F.lit(1))
    kind = F.try_element_at(F.filter(matches, lambda m: m["category"] == "type"), F.lit(-1))
    return F.coalesce(named(role), named(kind), F.lit("Code Block"))


def distinct_labels(matches: Column) -> Column:
    """All labels of a hit, sorted; one ``Code Block`` if there is none."""
    found = F.array_sort(F.array_distinct(F.transform(F.coalesce(matches, F.array().cast("array<struct<category:string,value:string,label:string>>")), lambda m: F.coalesce(m["label"], m["value"]))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Code Block")))


def search_tags(matches: Column) -> Column:
    """The lower-case values and label words of a node's matches, sorted and joined by blanks."""
    words = F.flatten(F.transform(matches, lambda m: F.concat(F.array(F.lower(m["value"])), F.split(F.lower(F.coalesce(m["label"], F.lit(""))), r"\s+"))))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 0))), " ")


def parent_context(kind: Column, path: Column, line: Column) -> Column:
    """Where a hit lies; null for whole modules."""
    return F.when(kind != "module", F.format_string("Inside %s defined in %s (L%d)", kind, path, line))


def skip_reason(path: Column, size: Column, head: Column) -> Column:
    """Why a file isn't parsed: too large, binary, minified or generated; null for the rest. ``head`` is the start of its text."""
    first = F.substring(head, 1, 2048)
    long_line = F.exists(F.slice(F.split(first, "\n"), 1, 5), lambda x: F.octet_length(x) > 1000)
    made = F.lower(F.substring(head, 1, 500)).rlike("generated by|auto-generated|do not edit")
    too_large = F.format_string("File too large (%.2f MB)", size / F.lit(1048576.0))
    return F.when(size > MAX_FILE_BYTES, too_large).when(F.instr(F.substring(head, 1, 1024), "\0") > 0, "Binary file detected").when(long_line, "Minified").when(made, "Generated")


def in_pruned_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in PRUNED_DIRS]))


#: Extensions that are left out although their language is known.
EXCLUDED_EXTENSIONS = {"javascript": ("min.js", "bundle.js"), "typescript": ("d.ts",), "python": ("pyi",)}


def should_process(path: Column, excluded: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether a path is source by its names alone: not below a pruned or hidden directory, no hidden file, no ``.lock`` and no extension in ``excluded`` (by language)."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~in_pruned_dir(path) & ~F.exists(folders, lambda d: F.startswith(d, F.lit("."))) & ~F.startswith(base_name(path), F.lit(".")) & ~F.endswith(path, F.lit(".lock")) & ~any_of([F.lit(False), *(F.endswith(path, F.lit("." + x)) for group in (excluded or {}).values() for x in group)])


def prompt(path: Column, language: Column, category: Column, matches: Column, defines: Column, content: Column) -> Column:
    """The text that is embedded for a node; lines without a value are left out."""
    line = lambda name, x: F.when(F.length(x) > 0, F.concat(F.lit(name + ": "), x))
    pick = lambda test: F.array_join(F.transform(F.filter(F.coalesce(matches, F.array().cast("array<struct<category:string,value:string,label:string>>")), test), lambda m: F.coalesce(m["label"], m["value"])), ", ")
    role = pick(lambda m: m["category"] == "role")
    tags = pick(lambda m: ~m["category"].isin("role", "type"))
    return F.concat_ws("\n", line("File", path), line("Language", language), line("Category", category), line("Role", role), line("Tags", tags), line("Defines", F.array_join(F.array_sort(F.array_distinct(F.coalesce(defines, F.array().cast("array<string>")))), ", ")), F.lit("[CODE]"), content)


def cleaned_for_embedding(text: Column, limit: int | None = 25_000, blank: str = "empty_node_content") -> Column:
    """Newlines become blanks, blank texts a placeholder; with a ``limit``, the provider's request size, long texts end there."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    flat = F.substring(flat, 1, limit) if limit else flat
    return F.when(F.trim(flat) == "", blank).otherwise(flat)


def clean_text(text: str, limit: int | None = None) -> str:
    """The same for one text on a provider's side; without ``limit`` the whole text, of which a blank one is ``empty``."""
    flat = text.replace("\n", " ")[:limit]
    return flat if flat.strip() else "empty" if limit is None else "empty_node_content"


def capture_parts(name: Column) -> Column:
    """``category, value`` of a capture's name, split at its first dot; null for a name without a dot, which only helps a rule."""
    at = F.instr(name, ".")
    return F.when(at > 0, F.struct(F.substring(name, F.lit(1), at - 1).alias("category"), F.substring(name, at + 1, F.length(name)).alias("value")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null where either vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, columns)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, columns)
