"""Capture rules from files: one for each language, added to the built-in ones.

``<language>.json`` holds a list of ``{"pattern": ..., "capture": "role.api_endpoint"}``; a pattern is a regular expression over the
file's bytes, whose first group, or whole match, is captured. As with the names of captures elsewhere, a name without a dot is left out.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

Rules = dict[str, list[tuple[bytes, str, str]]]


def load_rules(folder: str) -> Rules:
    """The rules of all languages in a folder; a pattern that isn't valid raises ``ValueError`` with its file."""
    out: Rules = {}
    for path in sorted(Path(folder).glob("*.json")):
        for rule in json.loads(path.read_text()):
            category, dot, value = rule["capture"].partition(".")
            try:
                re.compile(rule["pattern"].encode())
            except re.error as e:
                raise ValueError(f"{path.name}: {e}") from e
            if dot:
                out.setdefault(path.stem, []).append((rule["pattern"].encode(), category, value))
    return out
