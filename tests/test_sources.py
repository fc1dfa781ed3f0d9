import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.sources import files
from tesserae.sources.files import ContentConfig, LauncherConfig, applications, choose_importer, extracted, file_type, ingest, installed_applications, listing


def pack(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return buf.getvalue()


def test_extraction(spark):
    rows = [
        ("/a.txt", b"plain words", None), ("/b.html", b"<p>Tag</p><script>no</script>", None), ("/c.bin", b"\x00\x01", None), ("/d.txt", b"\x00bin", None),
        ("/e.docx", pack({"word/document.xml": "<w>Doc &amp; text</w>", "word/styles.xml": "<x>style</x>", "word/header1.xml": "<w>Head</w>"}), None),
        ("/f.xlsx", pack({"xl/sharedStrings.xml": "<t>cell</t>", "xl/worksheets/sheet1.xml": "<v>0</v>"}), None),
        ("/g.pptx", pack({"ppt/slides/slide1.xml": "<a>slide</a>", "ppt/notesSlides/notesSlide1.xml": "<a>note</a>"}), None),
        ("/h.ods", pack({"content.xml": "<t>calc</t>"}), None), ("/i.epub", pack({"x/ch1.xhtml": "<p>chapter</p>", "x/toc.ncx": "<t>toc</t>"}), None),
        ("/j.docx", b"not a zip", None), ("/k.pdf", b"%PDF-bad", None), ("/l.txt", None, None), ("/m", b"typed", "text/plain"),
    ]
    got = {r.path: r for r in extracted(spark.createDataFrame(rows, "path string, content binary, mime string"), ContentConfig()).collect()}
    text = {k: " ".join(v.text.split()) for k, v in got.items()}
    assert text["/a.txt"] == "plain words" and text["/b.html"] == "Tag" and text["/e.docx"] == "Doc & text Head"
    assert text["/f.xlsx"] == "cell" and text["/g.pptx"] == "slide note" and text["/h.ods"] == "calc" and text["/i.epub"] == "chapter"
    assert got["/c.bin"].status == "unsupported" and got["/d.txt"].status == "unsupported" and got["/l.txt"].status == "unsupported"
    assert got["/j.docx"].status in ("error", "ok") and got["/k.pdf"].status in ("unsupported", "error", "empty") and text["/m"] == "typed"


def test_caps(spark):
    rows = [("/a.txt", b"x" * 100, None)]
    df = spark.createDataFrame(rows, "path string, content binary, mime string")
    assert extracted(df, ContentConfig(max_file_mb=0)).first().text == ""


def test_listing(spark, tmp_path):
    for p in ("a.txt", "node_modules/b.txt", "sub/c.txt", "private/d.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    c = ContentConfig(roots=[str(tmp_path)], excludes=["node_modules"], exclude_paths=[str(tmp_path / "private")])
    assert sorted(r.name for r in listing(spark, c).collect()) == ["a.txt", "c.txt"]


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[content]\nroots = []\nmax_text_mb = 3\nexclude_paths = ["/x"]\nmatch = "substring"\n[search]\nfile_excludes = ["e"]\nfile_roots = ["~/p"]\n')
    c = ContentConfig.load(str(p), "/h")
    assert (c.roots, c.excludes, c.max_text_mb, c.match) == (["/h/p"], ["e"], 3, "substring")
    assert c.exclude_paths[0] == "/h/.ssh" and c.exclude_paths[-1] == "/x"
    c = ContentConfig.load(str(tmp_path / "none"), "/h")
    assert c.min_query == 3 and c.roots == ["/h"] and ".git" in c.excludes


def test_applications(spark):
    rows = [
        ("/2", "[Desktop Entry]\nName=Zed\nExec=zed %U\n[Desktop Action x]\nName=Other\n"),
        ("/1", "# c\n[Desktop Entry]\r\n  Name=Abe\r\nComment=a=b\r\n"),
        ("/3", "[Desktop Entry]\nName=Gone\nHidden=true"), ("/4", "[Desktop Entry]\nExec=x"), ("/5", None), ("/6", "Name=Outside"),
    ]
    got = {r.name: (r.exec, r.comment) for r in applications(spark.createDataFrame(rows, "path string, value string")).collect()}
    assert got == {"Zed": ("zed", ""), "Abe": ("", "a=b")}


def test_ingest(spark, tmp_path):
    big, odd = b"x" * 3000, pack({"mimetype": "application/epub+zip", "a/b.xhtml": "<p>chapter</p>"})
    made = {"a.txt": b"plain", "[b] {c}.md": b"# head", "noext": b"%PDF-1", "page": b"<!DOCTYPE html><p>Tag</p>", "big.txt": big, "book": odd, "x.bin": b"\x00\x01"}
    for k, v in made.items():
        (tmp_path / k).write_bytes(v)
    (tmp_path / "folder.txt").mkdir()
    paths = spark.createDataFrame([(str(tmp_path / k),) for k in (*made, "none.txt", "folder.txt")], "path string")
    got = {r.path.rsplit("/", 1)[1]: r for r in ingest(paths, ContentConfig(max_file_bytes=2000)).collect()}
    assert set(got) == set(made) and got["a.txt"].text == "plain" and got["[b] {c}.md"].mime == "text/markdown"
    assert got["big.txt"].size == 3000 and got["big.txt"].status == "unsupported" and got["big.txt"].text == ""
    assert got["page"].mime == "text/html" and got["page"].text.strip() == "Tag" and got["book"].text.strip() == "chapter" and got["noext"].importer == "pdf"
    assert ingest(paths.limit(0), ContentConfig()).count() == 0


def test_types_by_content():
    assert file_type(b"plain", "py") == "text/x-python" and file_type(b"plain", "") == "text/plain" and file_type(b"\x00", "") == "application/octet-stream"
    assert file_type(pack({"word/document.xml": ""}), "zip").endswith("wordprocessingml.document") and file_type(pack({"a": ""}), "docx") == "application/zip"
    assert file_type(b"\x89PNG\r\n\x1a\n", "txt") == "image/png" and file_type(None, "md") == "text/markdown"


def test_importer_choices_agree(spark):
    rows = [(m, f"/x/f{e}") for m in ("", "text/html", "application/pdf", "application/json", "image/png", "application/rtf", "application/vnd.oasis.opendocument.text") for e in ("", ".htm", ".pdf", ".docx", ".py", ".png")]
    for enabled in (("text", "pdf", "office", "html"), ("text",), ()):
        df = spark.createDataFrame(rows, "mime string, path string").select("mime", "path", T.importer(F.col("mime"), F.col("path"), enabled).alias("i"))
        assert all(choose_importer(r.mime, r.path.rsplit(".", 1)[1] if "." in r.path else "", enabled) == r.i for r in df.collect())


@pytest.mark.parametrize(
    ("script", "limits", "want"),
    [
        ("cat {}", {}, ("ok", "input")), ("exit 3", {}, ("error", "")), ("sleep 30", {"timeout_ms": 300}, ("timeout", "")), ("yes", {}, ("ok", "y\n" * 500)),
        ("while :; do :; done", {"cpu_seconds": 1}, ("error", "")), ("ulimit -c", {}, ("ok", "0\n")),
    ],
)
def test_tools_run_under_limits(script, limits, want):
    assert files._run(["sh", "-c", script], b"input", ".x", 1000, ContentConfig(**limits)) == want


def test_installed_applications(spark, tmp_path):
    (tmp_path / "a.desktop").write_text("[Desktop Entry]\nName=Abe\n")
    (tmp_path / "b.txt").write_text("[Desktop Entry]\nName=Not\n")
    assert [r.name for r in installed_applications(spark, [str(tmp_path), str(tmp_path / "none")]).collect()] == ["Abe"]
    assert installed_applications(spark, [str(tmp_path / "none")]).count() == 0
    folders = files.application_folders({"HOME": "/h", "XDG_DATA_HOME": "/d"})
    assert folders[:2] == ["/d/applications", "/h/.local/share/applications"] and len(folders) == 7 and len(files.application_folders({})) == 5


def test_launcher_settings(spark, tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[search]\nfiles = false\nfile_min_query = "x"\nfile_roots = ["/r"]\n[appearance]\nmax_per_group = 7\n[[commands]]\nname = "Say \\"hi\\""\ncommand = "echo"\nicon = 3\n[[commands]]\nname = ""\n')
    c = LauncherConfig.load(str(p))
    assert (c.files, c.file_min_query, c.file_roots, c.max_per_group) == (False, 2, ["/r"], 7)
    rows = c.command_rows(spark).filter(T.command_matches("HI")).collect()
    assert [(r.name, r.command, r.icon) for r in rows] == [('Say "hi"', "echo", "")]
    c.save(str(tmp_path / "sub" / "d.toml"))
    assert LauncherConfig.load(str(tmp_path / "sub" / "d.toml")) == c and LauncherConfig.load(str(tmp_path / "none")) == LauncherConfig()
