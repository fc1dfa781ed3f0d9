"""File sources: listing and reading folders, extracting text, application entries, settings."""

from __future__ import annotations

import contextlib
import fnmatch
import io
import json
import os
import resource
import shutil
import signal
import subprocess
import tempfile
import threading
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTENSION_TYPES, OFFICE, TEXT_TYPES, basename, dirname, excluded, extension, importer, strip_html_text, strip_xml_text, type_of_extension
from ..session import exists

#: Members of each container format that hold its text.
MEMBERS = {
    "docx": ("word/document.xml", "word/header*.xml", "word/footer*.xml", "word/footnotes.xml", "word/endnotes.xml"),
    "xlsx": ("xl/sharedStrings.xml",),
    "pptx": ("ppt/slides/slide*.xml", "ppt/notesSlides/notesSlide*.xml"),
    "odt": ("content.xml",), "ods": ("content.xml",), "odp": ("content.xml",),
    "epub": ("*.xhtml", "*.html", "*.htm"),
}
#: Folders skipped, and folders never read.
NOISE = (".git", "node_modules", ".cache", "target", ".venv", "__pycache__", ".cargo", ".rustup", "go/pkg", ".local/share/Trash", ".npm", "build")
PRIVATE = ("~/.ssh", "~/.gnupg", "~/.mozilla", "~/.local/share/keyrings", "~/.password-store")
_BY_MIME = (("wordprocessingml", "docx"), ("spreadsheetml", "xlsx"), ("presentationml", "pptx"), ("opendocument", "odt"), ("epub", "epub"))


@dataclass
class ContentConfig:
    """Settings of a file index. The names of the fields and their defaults."""

    roots: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    max_file_mb: int = 8
    max_file_bytes: int = 0  # if set, in place of max_file_mb
    max_text_mb: int = 2
    match: str = "prefix"
    min_query: int = 3
    max_results: int = 6
    extractors: tuple[str, ...] = ("text", "pdf", "office", "html")
    max_index_mb: int = 0  # size of the index at which a crawl stops; 0: none
    timeout_ms: int = 10_000
    cpu_seconds: int = 20  # limits of an external tool
    mem_limit_mb: int = 512
    nice: int = 10
    reconcile_interval_s: int = 900
    reconcile_interval_degraded_s: int = 180

    @property
    def most_bytes(self) -> int:
        return self.max_file_bytes or self.max_file_mb << 20

    @classmethod
    def load(cls, path: str, home: str = "~") -> ContentConfig:
        """From the tables [content] and [search] of a TOML file. Roots and excludes are the first list that isn't empty
        of [content], [search] (file_roots, file_excludes) and the defaults; private folders are added to the default
        ones. ~ is the home folder. A missing or malformed file gives the defaults."""
        home = os.path.expanduser(home)

        def full(paths: list[str]) -> list[str]:
            return [home + p[1:] if p == "~" or p.startswith("~/") else p for p in paths]

        try:
            with open(path, "rb") as f:
                data = tomllib.load(f)
        except (FileNotFoundError, tomllib.TOMLDecodeError):
            data = {}
        content, search = data.get("content", {}), data.get("search", {})
        known = {k: v for k, v in content.items() if k in cls.__dataclass_fields__ and type(v) is type(getattr(cls(), k, v))}
        out = cls(**known)
        out.roots = full(content.get("roots") or search.get("file_roots") or [home])
        out.excludes = content.get("excludes") or search.get("file_excludes") or list(NOISE)
        out.exclude_paths = list(dict.fromkeys(full([*PRIVATE, *content.get("exclude_paths", [])])))
        out.extractors = tuple(content.get("extractors") or out.extractors)
        out.match = "substring" if out.match == "substring" else "prefix"
        return out


def listing(spark: SparkSession, config: ContentConfig) -> DataFrame:
    """(path, name, parent, size, mtime_ns) of the regular files under the roots; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(config.roots)
    path = F.regexp_replace("path", "^file:/*", "/")
    df = df.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    return df.filter(~excluded(F.col("path"), config.exclude_paths, config.excludes)).select("path", basename(F.col("path")).alias("name"), dirname(F.col("path")).alias("parent"), "size", "mtime_ns")


def _run(command: list[str], content: bytes, suffix: str, most: int, config: ContentConfig) -> tuple[str, str]:
    """(status, output) of an external tool reading a file. It runs in a process group of its own under limits of time,
    CPU, data memory and file size; once `most` bytes have come out, or the time is over, the group is killed."""
    if not shutil.which(command[0]):
        return "unsupported", ""

    def limited() -> None:
        os.setpgid(0, 0)
        for what, value in ((resource.RLIMIT_CPU, config.cpu_seconds), (resource.RLIMIT_DATA, config.mem_limit_mb << 20), (resource.RLIMIT_FSIZE, 4 * most + (1 << 20)), (resource.RLIMIT_CORE, 0)):
            resource.setrlimit(what, (value, value))
        os.nice(config.nice)

    with tempfile.NamedTemporaryFile(suffix=suffix) as f:  # the tool's input, removed at once
        f.write(content)
        f.flush()
        tool = subprocess.Popen([c.replace("{}", f.name) for c in command], stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, preexec_fn=limited)
        late = threading.Event()

        def end() -> None:
            with contextlib.suppress(ProcessLookupError):
                os.killpg(tool.pid, signal.SIGKILL)

        timer = threading.Timer(config.timeout_ms / 1000, lambda: (late.set(), end()))
        timer.start()
        try:
            out = b""
            while len(out) < most and (part := tool.stdout.read(min(1 << 16, most - len(out)))):
                out += part
            full = len(out) >= most
            if full:
                end()
            code = tool.wait()
        finally:
            timer.cancel()
            end()
            tool.stdout.close()
    if late.is_set():
        return "timeout", ""
    return ("ok" if full or code == 0 else "error"), out.decode("utf-8", "replace")


def read_text(content: bytes, ext: str, mime: str, config: ContentConfig) -> tuple[str, str]:
    head = content[:8192]
    odd = sum(b < 32 and not 9 <= b <= 13 for b in head)
    if not head or 0 in head or odd * 100 >= len(head) * 5:
        return "unsupported", ""
    return "ok", content.decode("utf-8", "replace")


def read_html(content: bytes, ext: str, mime: str, config: ContentConfig) -> tuple[str, str]:
    return "ok", strip_html_text(content.decode("utf-8", "replace"))


def read_pdf(content: bytes, ext: str, mime: str, config: ContentConfig) -> tuple[str, str]:
    return _run(["pdftotext", "-q", "-enc", "UTF-8", "{}", "-"], content, ".pdf", config.max_text_mb << 20, config)


def read_office(content: bytes, ext: str, mime: str, config: ContentConfig) -> tuple[str, str]:
    """Text of the members of a ZIP container that hold it; else of an external converter."""
    kind = ext if ext in MEMBERS else next((k for m, k in _BY_MIME if not ext and m in mime), "")
    most, parts = config.max_text_mb << 20, []
    if kind:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
                for pattern in MEMBERS[kind]:
                    for n in names:
                        if fnmatch.fnmatchcase(n, pattern) and sum(map(len, parts)) < most:
                            with z.open(n) as f:
                                parts.append(f.read(most).decode("utf-8", "replace"))
        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
            parts = []
    text = " ".join(strip_html_text(p) if kind == "epub" else strip_xml_text(p) for p in parts)
    if text.strip():
        return "ok", text
    for command in (["pandoc", "-t", "plain", "{}"], ["odt2txt", "{}"]):
        status, text = _run(command, content, f".{ext}", most, config)
        if status == "ok" and text.strip():
            return status, text
    return ("error" if kind else "unsupported"), ""


#: Importers by name; others can be registered.
IMPORTERS: dict[str, Callable[[bytes, str, str, ContentConfig], tuple[str, str]]] = {"text": read_text, "html": read_html, "pdf": read_pdf, "office": read_office}


#: First bytes of formats.
MAGIC = (
    (b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"\x1f\x8b", "application/gzip"),
    (b"BZh", "application/x-bzip2"), (b"\xfd7zXZ\x00", "application/x-xz"), (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"), (b"Rar!", "application/vnd.rar"),
    (b"\x7fELF", "application/x-executable"), (b"fLaC", "audio/flac"), (b"OggS", "audio/ogg"), (b"ID3", "audio/mpeg"), (b"{\\rtf", "application/rtf"), (b"#!", "text/x-shellscript"),
)
_PARTS = (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"))


def type_of_content(content: bytes) -> str:
    """MIME type by the content: first bytes, members of a container, markup, else text or unknown bytes."""
    for head, mime in MAGIC:
        if content.startswith(head):
            return mime
    if content.startswith(b"PK\x03\x04"):
        with contextlib.suppress(zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, KeyError):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
                if "mimetype" in names:
                    return z.read("mimetype")[:200].decode("ascii", "replace").strip()
                for folder, kind in _PARTS:
                    if any(n.startswith(folder) for n in names):
                        return EXTENSION_TYPES[kind]
        return "application/zip"
    start = content[:1024].removeprefix(b"\xef\xbb\xbf").lstrip().lower()
    if start.startswith((b"<!doctype html", b"<html")):
        return "text/html"
    if start.startswith(b"<?xml"):
        return "text/xml"
    return "text/plain" if read_text(content, "", "", ContentConfig())[0] == "ok" else "application/octet-stream"


def file_type(content: bytes | None, ext: str) -> str:
    """By content; where that is plain text or unknown, by the extension if it says more."""
    found = type_of_content(content) if content else "application/octet-stream"
    return EXTENSION_TYPES.get(ext, found) if found in ("text/plain", "application/octet-stream") else found


def choose_importer(mime: str, ext: str, enabled: tuple[str, ...]) -> str:
    """The same choice as functions.text.importer, for one file."""
    if "html" in enabled and (mime == "text/html" or ext in ("html", "htm")):
        return "html"
    if "pdf" in enabled and (mime == "application/pdf" or ext == "pdf"):
        return "pdf"
    if "office" in enabled and (ext in OFFICE or "opendocument" in mime or "officedocument" in mime or mime in ("application/rtf", "application/epub+zip")):
        return "office"
    return "text" if "text" in enabled and (mime.startswith("text/") or mime in TEXT_TYPES or ext in EXTENSION_TYPES) else ""


def clean_text(text: str, most: int) -> str:
    """At most `most` bytes, without NUL, other control characters but the white ones as blanks."""
    text = text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "replace")
    return text.replace("\x00", "").translate({c: " " for c in range(32) if not 9 <= c <= 13})


def extract(content: bytes | None, ext: str, mime: str, name: str, config: ContentConfig) -> tuple[str, str]:
    """(status, text) of one file by the importer `name`."""
    read = IMPORTERS.get(name)
    try:
        status, text = read(content, ext, mime, config) if read and content is not None else ("unsupported", "")
    except Exception:  # one bad file must not end the job
        status, text = "error", ""
    text = clean_text(text, config.max_text_mb << 20)
    return ("empty" if status == "ok" and not text.strip() else status), text


def extracted(files: DataFrame, config: ContentConfig) -> DataFrame:
    """(path, status, text, mime, importer) of files (path, content binary, mime). Oversize and unsupported files have an
    empty text; null contents are unsupported."""
    typed = files.withColumn("mime", F.coalesce("mime", type_of_extension(extension(F.col("path"))), F.lit(""))).select("path", F.when(F.length("content") <= config.most_bytes, F.col("content")).alias("content"), "mime", extension(F.col("path")).alias("ext"), importer(F.col("mime"), F.col("path"), config.extractors).alias("importer"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [extract(None if c is None else bytes(c), e, m, n, config) for c, e, m, n in zip(pdf["content"], pdf["ext"], pdf["mime"], pdf["importer"])]
            yield pd.DataFrame({"path": pdf["path"], "status": [g[0] for g in got], "text": [g[1] for g in got], "mime": pdf["mime"], "importer": pdf["importer"]})

    return typed.mapInPandas(run, "path string, status string, text string, mime string, importer string")


INGESTED = "path string, size long, mtime_ns long, status string, text string, mime string, importer string"
ROWS, TEXT_BYTES = 256, 16 << 20  # of a batch that leaves the reader


def ingest(paths: DataFrame, config: ContentConfig) -> DataFrame:
    """INGESTED of the files named in paths (path) that exist: each is opened where its task runs, so names and contents
    never pass through the driver, and a file over the size cap isn't read at all. Paths may be those of any file system
    that the workers reach (file:, hdfs:, s3:, ...)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        import pyarrow.fs as pfs

        for pdf in batches:
            for path in pdf["path"]:
                try:
                    fs, name = pfs.FileSystem.from_uri(path) if "://" in path else (pfs.LocalFileSystem(), path)
                    info = fs.get_file_info(name)
                    if info.type != pfs.FileType.File:
                        continue
                    content = None
                    if info.size <= config.most_bytes:
                        with fs.open_input_stream(name) as f:
                            content = f.read(config.most_bytes + 1)
                except FileNotFoundError:
                    continue
                except OSError:
                    yield path, 0, 0, "error", "", "", ""
                    continue
                ext = path.rsplit("/", 1)[-1]
                ext = ext.rsplit(".", 1)[1].lower() if "." in ext[1:] else ""
                mime = file_type(content, ext)
                kind = choose_importer(mime, ext, config.extractors)
                status, text = extract(content, ext, mime, kind, config)
                yield path, info.size, info.mtime_ns or 0, status, text, mime, kind

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in INGESTED.split(", ")]
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row[4])
            if len(held) >= ROWS or size >= TEXT_BYTES:
                yield pd.DataFrame(held, columns=names)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    return paths.select("path").repartition(4 * paths.sparkSession.sparkContext.defaultParallelism, "path").mapInPandas(run, INGESTED)


def application_folders(environment: dict[str, str]) -> list[str]:
    """Folders of application entries. Their order and names."""
    out = []
    if environment.get("XDG_DATA_HOME"):
        out.append(environment["XDG_DATA_HOME"] + "/applications")
    if "HOME" in environment:
        out.append(environment["HOME"] + "/.local/share/applications")
    system = ("/usr/share/applications", "/usr/local/share/applications", "/usr/share/gnome/applications", "/usr/share/gnome/apps", "/usr/share/mate/applications")
    return [*out, *system]


def installed_applications(spark: SparkSession, folders: list[str]) -> DataFrame:
    """applications of the *.desktop files right in the folders that exist."""
    there = [f for f in folders if exists(spark, f)]
    if not there:
        return applications(spark.createDataFrame([], "path string, value string"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.desktop").load(there)
    return applications(found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("value")))


@dataclass
class LauncherConfig:
    """Settings of the search over all providers, and the user's commands. Names and defaults."""

    applications: bool = True
    files: bool = True
    calculator: bool = True
    commands: bool = True
    file_min_query: int = 2
    max_file_results: int = 8
    max_per_group: int = 4
    group_by_app: bool = True
    file_roots: list[str] = field(default_factory=list)
    file_excludes: list[str] = field(default_factory=list)
    user_commands: list[dict[str, str]] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> LauncherConfig:
        """From the tables [search], [appearance], [app_switcher] and the list [[commands]] of a TOML file; values of
        another type, a missing and a malformed file leave the defaults."""
        try:
            with open(path, "rb") as f:
                data = tomllib.load(f)
        except (FileNotFoundError, tomllib.TOMLDecodeError):
            data = {}
        given: dict = {}
        for name in ("search", "appearance", "app_switcher"):
            part = data.get(name)
            given |= part if isinstance(part, dict) else {}
        plain = cls()
        out = cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__ and k != "user_commands" and type(v) is type(getattr(plain, k))})
        rows = data.get("commands")
        keys = ("name", "command", "icon", "shortcut", "category")
        out.user_commands = [{k: r[k] if isinstance(r.get(k), str) else "" for k in keys} for r in (rows if isinstance(rows, list) else []) if isinstance(r, dict)]
        return out

    def command_rows(self, spark: SparkSession) -> DataFrame:
        """(name, command, icon, shortcut, category) of the user's commands."""
        return spark.createDataFrame([tuple(c.values()) for c in self.user_commands], "name string, command string, icon string, shortcut string, category string")

    def save(self, path: str) -> None:
        """As TOML that load reads."""
        tables = {"search": ("applications", "files", "calculator", "commands", "file_min_query", "max_file_results", "file_roots", "file_excludes"), "appearance": ("max_per_group",), "app_switcher": ("group_by_app",)}
        lines = []
        for name, keys in tables.items():
            lines += [f"[{name}]", *(f"{k} = {json.dumps(getattr(self, k), ensure_ascii=False)}" for k in keys), ""]
        for c in self.user_commands:
            lines += ["[[commands]]", *(f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in c.items()), ""]
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write("\n".join(lines))


ENTRY_KEYS = {"Name": "name", "Exec": "exec", "Icon": "icon", "Categories": "categories", "Comment": "comment", "GenericName": "generic_name"}


def applications(entries: DataFrame) -> DataFrame:
    """Shown applications of desktop entries (path, value: the whole file), by name: the last value of each key of the
    section [Desktop Entry]; entries without name, hidden or not displayed are left out; Exec ends at its field codes."""
    lines = F.transform(F.split("value", "\r?\n"), lambda x: F.regexp_replace(x, r"^[ \t]+", ""))
    # the section of a line is the last header before it
    state = F.aggregate(
        F.filter(lines, lambda x: (x != "") & ~x.startswith("#")),
        F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<key:string,value:string>>").alias("kept")),
        lambda acc, x: F.when(x.startswith("["), F.struct((x == "[Desktop Entry]").alias("inside"), acc["kept"].alias("kept")))
        .when(acc["inside"] & x.contains("="), F.struct(acc["inside"].alias("inside"), F.concat(acc["kept"], F.array(F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_extract(x, r"^[^=]*=(.*)$", 1).alias("value")))).alias("kept")))
        .otherwise(acc),
    )
    kept = entries.filter("value is not null").select("path", state["kept"].alias("kept"))

    def last(key: str):
        return F.coalesce(F.try_element_at(F.filter("kept", lambda p: p["key"] == key), F.lit(-1))["value"], F.lit(""))

    out = kept.select("path", *[last(k).alias(v) for k, v in ENTRY_KEYS.items()], (last("NoDisplay") == "true").alias("no_display"), (last("Hidden") == "true").alias("hidden"))
    shown = out.filter((F.col("name") != "") & ~F.col("no_display") & ~F.col("hidden"))
    return shown.withColumn("exec", F.substring_index("exec", " %", 1)).drop("no_display", "hidden").orderBy("name", "path")
