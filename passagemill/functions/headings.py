"""The heading tests as plain Python, for the passage splitter; patterns are those of the expressions in :mod:`text`."""

from __future__ import annotations

import re

from . import text as patterns

_IDENTIFIER, _ARTICLE, _UPPERCASE = (re.compile(p) for p in (patterns.IDENTIFIER, patterns.ARTICLE, patterns.UPPERCASE))
_COUNTED = [re.compile(p) for p in (patterns.NUMBERED, patterns.ROMAN)]
_LEGACY = re.compile(patterns.LEGACY_HEADING)
_WORD = re.compile(r"[^\W\d_]{3,}")


def _titular(text: str) -> bool:
    letters, dense = sum(map(str.isalpha, text)), len("".join(text.split()))
    return letters >= patterns.LEAST_LETTERS and letters >= patterns.LEAST_RATIO * dense and bool(_WORD.search(text))


def is_heading(text: str) -> bool:
    line = text.strip()
    if not 0 < len(line) <= patterns.LONGEST_HEADING or _IDENTIFIER.match(line):
        return False
    for pattern in _COUNTED:
        if found := pattern.match(line):
            return _titular(found[1])
    return bool(_ARTICLE.match(line) or _UPPERCASE.match(line)) and _titular(line)


def is_legacy_heading(text: str) -> bool:
    return len(text) <= patterns.LONGEST_HEADING and bool(_LEGACY.fullmatch(text.strip()))
