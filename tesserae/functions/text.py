"""Scalar text functions as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: MIME type of each extension.
EXTENSION_TYPES = {
    "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "rst": "text/plain", "log": "text/plain", "csv": "text/csv",
    "json": "application/json", "xml": "text/xml", "yaml": "text/yaml", "yml": "text/yaml", "toml": "text/plain", "ini": "text/plain",
    "conf": "text/plain", "c": "text/x-c", "h": "text/x-c", "cpp": "text/x-c++", "cc": "text/x-c++", "hpp": "text/x-c++",
    "py": "text/x-python", "rs": "text/x-rust", "go": "text/x-go", "js": "text/javascript", "ts": "text/x-typescript", "sh": "text/x-shellscript",
    "java": "text/x-java", "rb": "text/x-ruby", "lua": "text/x-lua", "html": "text/html", "htm": "text/html", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation",
    "rtf": "application/rtf", "epub": "application/epub+zip",
}
OFFICE = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "rtf", "epub")
TEXT_TYPES = ("application/json", "application/xml", "application/javascript", "application/x-shellscript")


def extension(path: Column) -> Column:
    """Lower-cased extension of the last component, '' if none; of a dot file without another dot, none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def type_of_extension(ext: Column) -> Column:
    """MIME type of an extension, '' if unknown."""
    types = F.create_map(*[F.lit(x) for kv in EXTENSION_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(types, ext), F.lit(""))


def importer(mime: Column, path: Column, enabled: tuple[str, ...] = ("text", "pdf", "office", "html")) -> Column:
    """Which importer reads a file: html, pdf, office, text, or '' for none."""
    ext, m = extension(path), F.coalesce(mime, F.lit(""))
    on = {k: F.lit(k in enabled) for k in ("html", "pdf", "office", "text")}
    return (
        F.when(on["html"] & ((m == "text/html") | ext.isin("html", "htm")), "html")
        .when(on["pdf"] & ((m == "application/pdf") | (ext == "pdf")), "pdf")
        .when(on["office"] & (ext.isin(*OFFICE) | m.contains("opendocument") | m.contains("officedocument") | m.isin("application/rtf", "application/epub+zip")), "office")
        .when(on["text"] & (m.startswith("text/") | m.isin(*TEXT_TYPES) | (type_of_extension(ext) != "")), "text")
        .otherwise("")
    )


def sanitized(text: Column) -> Column:
    """Without NUL, other control characters but the white ones (9 to 13) as blanks."""
    return F.regexp_replace(F.regexp_replace(text, r"\x00", ""), r"[\x01-\x08\x0e-\x1f]", " ")


def looks_like_text(text: Column) -> Column:
    """No NUL in the first 8192 characters, and control characters under 5 % of them; empty isn't text."""
    head = F.substring(text, 1, 8192)
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x01-\x08\x0e-\x1f]", ""))
    return F.coalesce((F.length(head) > 0) & ~F.contains(head, F.lit("\x00")) & (odd * 100 < F.length(head) * 5), F.lit(False))


#: Entities of HTML text in the order they are decoded.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))


#: Script and style blocks, tags (the group keeps their '<' as a mark), and a tag without end.
MARKUP = r"(?s)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|(<)[^>]*>|<[^>]*\z"


def strip_html(text: Column) -> Column:
    """Script and style blocks dropped (with the rest of the text if not closed), tags as blanks, a tag without end
    drops the rest, then seven entities one kind after the other; &amp; keeps being decoded where it yields another."""
    out = F.translate(F.regexp_replace(text, MARKUP, "$1"), "<", " ")
    for name, char in ENTITIES:
        out = F.regexp_replace(out, r"&(?:amp;)+", "&") if name == "&amp;" else F.replace(out, F.lit(name), F.lit(char))
    return out


_XML_ENTITY = re.compile(r"&([^;&]{1,9});")
_XML_NAMES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _xml_entity(m: re.Match) -> str:
    name = m.group(1)
    if name in _XML_NAMES:
        return _XML_NAMES[name]
    if name.startswith("#"):
        try:
            cp = int(name[2:], 16) if name[1:2] in "xX" else int(name[1:])
        except ValueError:
            return m.group()
        return chr(cp) if 0 < cp < 0x110000 and not 0xD800 <= cp < 0xE000 else ""
    return m.group()


def strip_xml_text(text: str) -> str:
    """Tags as blanks, named and numeric entities decoded in one pass."""
    return _XML_ENTITY.sub(_xml_entity, re.sub(r"(<)[^>]*>|<[^>]*\Z", lambda m: " " if m[1] else "", text))


@F.pandas_udf(StringType())
def _entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _XML_ENTITY.sub(_xml_entity, t), na_action="ignore")


def strip_xml(text: Column) -> Column:
    """strip_xml_text as a column; only texts with a numeric entity leave the engine."""
    bare = F.translate(F.regexp_replace(text, r"(<)[^>]*>|<[^>]*\z", "$1"), "<", " ")
    named = bare
    for name, char in _XML_NAMES.items():  # &amp; last, so that what it yields isn't decoded again
        if name != "amp":
            named = F.replace(named, F.lit(f"&{name};"), F.lit(char))
    named = F.replace(named, F.lit("&amp;"), F.lit("&"))
    return F.when(F.contains(bare, F.lit("&#")), _entities(bare)).otherwise(named)


def strip_html_text(text: str) -> str:
    text = re.sub(MARKUP.replace(r"\z", r"\Z"), lambda m: " " if m[1] else "", text)
    for name, char in ENTITIES:
        text = re.sub(r"&(?:amp;)+", "&", text) if name == "&amp;" else text.replace(name, char)
    return text


def local_time(mtime_ns: Column) -> Column:
    """A time in nanoseconds as 'Jan 02, 2025  13:45' in the session's time zone."""
    return F.date_format(F.timestamp_seconds(F.call_function("div", mtime_ns, F.lit(1_000_000_000))), "MMM dd, yyyy  HH:mm")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def badge(path: Column) -> Column:
    """Extension in capitals, five characters at most, FILE without one."""
    ext = F.upper(F.substring(extension(path), 1, 5))
    return F.when(ext == "", "FILE").otherwise(ext)


#: Icon family of extensions.
ICONS = {
    "image-x-generic": ("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp"), "audio-x-generic": ("mp3", "flac", "ogg", "wav", "m4a"),
    "video-x-generic": ("mp4", "mkv", "webm", "mov"), "application-pdf": ("pdf",), "package-x-generic": ("zip", "tar", "gz", "xz", "7z", "rar"),
    "text-x-script": ("cpp", "hpp", "h", "c", "py", "js", "ts", "rs", "go", "java", "sh"),
}


def icon(path: Column) -> Column:
    """Icon family by extension."""
    ext, out = extension(path), F.lit("text-x-generic")
    for name, extensions in ICONS.items():
        out = F.when(ext.isin(*extensions), name).otherwise(out)
    return out


def human_size(size: Column) -> Column:
    """Bytes as 'N B', else one decimal in KB, MB, GB or TB (powers of 1024), halves to even."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", F.bround(size / 1024.0**k, 1)), F.lit(" " + unit))).otherwise(out)
    return out


def escape_markup(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def snippet_markup(snippet: Column, accent: str = "#3584e4") -> Column:
    """An excerpt whose hits stand between the characters 2 and 3, as markup; a mark without its pair is dropped."""
    spans = F.regexp_replace(escape_markup(snippet), r"\x02([^\x03]*)\x03", f'<span foreground="{accent}" weight="bold">$1</span>')
    return F.translate(spans, "\x02", "")


def percent_encoded(path: Column) -> Column:
    """Bytes other than unreserved ones and '/' as %XX."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def abbreviated(path: Column, home: str) -> Column:
    """The home folder as ~."""
    h = home.rstrip("/")
    return F.when(path == h, "~").when(path.startswith(h + "/"), F.concat(F.lit("~"), F.substring(path, len(h) + 1, 1 << 20))).otherwise(path)


def expanded(path: Column, home: str) -> Column:
    h = home.rstrip("/")
    return F.when(path == "~", h).when(path.startswith("~/"), F.concat(F.lit(h), F.substring(path, 2, 1 << 20))).otherwise(path)


def monogram(label: Column) -> Column:
    """First ASCII letter, in capitals; without one the first character, '#' for an empty label."""
    c = F.upper(F.regexp_extract(label, "[A-Za-z]", 0))
    return F.when(c != "", c).when(label == "", "#").otherwise(F.substring(label, 1, 1))


def entry_names(app_id: Column) -> Column:
    """File names an application id may have, sorted and distinct: as it is, its last and its first part, with dashes,
    with underscores."""
    forms = (app_id, F.substring_index(app_id, ".", -1), F.substring_index(app_id, ".", 1), F.translate(app_id, ".", "-"), F.translate(app_id, ".", "_"))
    return F.array_sort(F.array_distinct(F.array(*[F.concat(f, F.lit(".desktop")) for f in forms])))


def application_matches(query: str, columns: tuple[str, ...] = ("name", "generic_name", "comment", "categories")) -> Column:
    """The query is part of any of the columns, in any case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.lower(F.coalesce(c, F.lit(""))).contains(query.lower())
    return out


def command_matches(query: str, name: str = "name", command: str = "command") -> Column:
    """The query is part of the name, in any case; of entries with a name and a command."""
    filled = (F.coalesce(name, F.lit("")) != "") & (F.coalesce(command, F.lit("")) != "")
    return filled & F.lower(F.coalesce(name, F.lit(""))).contains(query.lower())


def inside_roots(path: Column, roots: list[str]) -> Column:
    """Under one of the roots, or one itself."""
    out = F.lit(False)
    for r in roots:
        out = out | within(path, r)
    return out


def within(path: Column, folder: str) -> Column:
    """The folder itself or anything under it; a sibling whose name begins alike isn't."""
    f = folder.rstrip("/") if folder != "/" else ""
    return (path == f) | path.startswith(f + "/") if f else path.startswith("/")


def excluded(path: Column, folders: list[str] = (), patterns: list[str] = ()) -> Column:
    """Under a private folder, with a component equal to a bare pattern, or containing a pattern with '/'."""
    out = F.lit(False)
    for f in folders:
        out = out | within(path, f)
    for p in patterns:
        if p:
            out = out | (path.contains(p) if "/" in p else F.array_contains(F.split(path, "/"), p))
    return out


def recency_bonus(mtime_s: Column, now: int) -> Column:
    days = (F.lit(now) - mtime_s) / 86400.0
    return F.when(days < 1, 60.0).when(days < 7, 40.0).when(days < 30, 20.0).when(days < 365, 8.0).otherwise(0.0)


def name_score(name: Column, query: str, longest: int = 500, other: float = 50.0) -> Column:
    """1000 less the length for a prefix, 600 less the position for a substring, `other` for a match elsewhere."""
    n = F.lower(name)
    pos = F.instr(n, query.lower()) - 1
    return F.when(pos == 0, 1000.0 - F.least(F.length(n), F.lit(longest))).when(pos > 0, 600.0 - F.least(pos, F.lit(300))).otherwise(other)


def command_score(name: Column, query: str) -> Column:
    pos = F.instr(F.lower(name), query.lower()) - 1
    return F.when(pos == 0, 900.0).otherwise(400.0) - F.least(pos, F.lit(200))


def file_score(name: Column, path: Column, is_dir: Column, mtime_s: Column, query: str, now: int) -> Column:
    return name_score(name, query, 300, 200.0) - 6.0 * depth(path) + F.when(is_dir, 15.0).otherwise(0.0) + recency_bonus(mtime_s, now)
