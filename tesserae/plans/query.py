"""Search strings: predicates and free text.

`key:value` words become predicates (kind, ext, name, size, modified/mtime/date); anything else, malformed predicates
included, stays text. Predicates are combined with AND, the patterns of all kinds with OR.
"""

from __future__ import annotations

import calendar
import re
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tokens import query_tokens

#: MIME patterns of each kind.
KINDS = {
    "pdf": ["application/pdf"],
    "image": ["image/*"],
    "audio": ["audio/*"],
    "video": ["video/*"],
    "text": ["text/*"],
    "code": ["text/x-*", "application/json", "application/javascript", "application/xml", "application/x-shellscript"],
    "archive": ["application/zip", "application/x-tar", "application/gzip", "application/x-7z-compressed", "application/x-bzip2", "application/x-xz", "application/vnd.rar", "application/x-rar-compressed"],
    "spreadsheet": ["*spreadsheetml*", "*opendocument.spreadsheet*", "text/csv", "application/vnd.ms-excel"],
    "presentation": ["*presentationml*", "*opendocument.presentation*", "application/vnd.ms-powerpoint"],
    "doc": ["*wordprocessingml*", "*opendocument.text*", "application/pdf", "application/rtf", "application/epub+zip", "text/markdown"],
}
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
_SPANS = {"h": 3600, "d": 86400, "w": 604800}


@dataclass
class Predicates:
    mime_patterns: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    name_parts: list[str] = field(default_factory=list)
    size_min: int | None = None
    size_max: int | None = None
    mtime_min: int | None = None  # nanoseconds
    mtime_max: int | None = None
    active: bool = False


def _lower(s: str) -> str:
    """Lower case of ASCII letters only."""
    return re.sub("[A-Z]+", lambda m: m.group().lower(), s)


def parse_size(s: str) -> int | None:
    m = re.fullmatch(r"([0-9]+)([kmgKMG]?)", s)
    return int(m[1]) * _UNITS[m[2].lower()] if m else None


def parse_window(value: str, now: int) -> tuple[int | None, int | None] | None:
    """Bounds in seconds of a modified: value, or None if it isn't one. Days are UTC days."""
    sign = value[:1] if value[:1] in ("<", ">") else ""
    v = value[len(sign) :].removeprefix("=")
    today = now - now % 86400
    if v == "today":
        return today, None
    if v == "yesterday":
        return today - 86400, today - 1
    if m := re.match(r"([0-9]+).*?([hdw])$", v, re.S):
        at = now - int(m[1]) * _SPANS[m[2]]
        return (None, at) if sign == ">" else (at, None)
    if len(v) == 10 and (m := re.fullmatch(r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", v)):
        try:
            day = calendar.timegm((int(m[1]), int(m[2]), int(m[3]), 0, 0, 0)) if 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31 else None
        except ValueError:
            day = None
        if day is not None:
            return {"<": (None, day - 1), ">": (day + 86400, None), "": (day, day + 86399)}[sign]
    return None


def parse(query: str, now: int = 0) -> tuple[Predicates, str]:
    """Predicates and remaining text; now is in seconds, 0 for the clock."""
    now = now or int(time.time())
    p, text = Predicates(), []
    for word in query.split():
        key, colon, value = word.partition(":")
        if not (key and colon and value and _predicate(p, _lower(key), value, now)):
            text.append(word)
    return p, " ".join(text)


def _predicate(p: Predicates, key: str, value: str, now: int) -> bool:
    if key == "kind" and _lower(value) in KINDS:
        p.mime_patterns += KINDS[_lower(value)]
    elif key == "ext" and not set(value) & set("%_\\"):
        p.extensions.append(_lower(value))
    elif key == "name":
        p.name_parts.append(_lower(value))
    elif key == "size":
        sign, rest = value[0], value[1:]
        size = parse_size(rest.removeprefix("=")) if sign in "<>" else None
        if size is None:
            return False
        exact = rest.startswith("=")
        if sign == ">":
            p.size_min = size if exact else size + 1
        else:
            p.size_max = size if exact else size - 1
    elif key in ("modified", "mtime", "date") and (w := parse_window(value, now)):
        if w[0]:
            p.mtime_min = w[0] * 10**9
        if w[1]:
            p.mtime_max = w[1] * 10**9
    else:
        return False
    p.active = True
    return True


def _glob(c: Column, pattern: str) -> Column:
    body = pattern.strip("*")
    if pattern.startswith("*") and pattern.endswith("*"):
        return c.contains(body)
    return c.startswith(body) if pattern.endswith("*") else c.endswith(body) if pattern.startswith("*") else c == body


def condition(p: Predicates) -> Column:
    """The predicates as one column over mime, name, size, mtime_ns."""
    name = F.lower("name")
    parts: list[Column] = []
    if p.mime_patterns:
        parts.append(reduce(Column.__or__, [_glob(F.col("mime"), g) for g in dict.fromkeys(p.mime_patterns)]))
    parts += [name.endswith("." + e) for e in p.extensions] + [name.contains(x) for x in p.name_parts]
    for bound, column, low in ((p.size_min, "size", True), (p.size_max, "size", False), (p.mtime_min, "mtime_ns", True), (p.mtime_max, "mtime_ns", False)):
        # bounds of a time at or before 0, and negative sizes, are not applied
        if bound is not None and (bound > 0 or column == "size" and bound >= 0):
            parts.append(F.col(column) >= bound if low else F.col(column) <= bound)
    return reduce(Column.__and__, parts, F.lit(True))


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False


def phrases(text: str, prefix_last: bool = True) -> list[Phrase]:
    """One phrase per word, all required; words without terms are left out."""
    out = [Phrase(tuple(t)) for w in text.split() if (t := query_tokens(w))]
    if out and prefix_last and text.split() and query_tokens(text.split()[-1]):
        out[-1] = Phrase(out[-1].terms, True)
    return out
