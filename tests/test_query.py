from tesserae.functions.tokens import query_tokens
from tesserae.plans.query import Phrase, parse, parse_size, phrases

NOW = 1_000_000_000
DAY = 86400


def test_plain_text_stays():
    p, text = parse("hello size:1M size:=1M kind:nothing note:", NOW)
    assert not p.active and text == "hello size:1M size:=1M kind:nothing note:"


def test_sizes():
    assert (parse("size:>1M", NOW)[0].size_min, parse("size:>=1M", NOW)[0].size_min) == ((1 << 20) + 1, 1 << 20)
    assert (parse("size:<2k", NOW)[0].size_max, parse("size:<=2K", NOW)[0].size_max) == (2047, 2048)
    assert parse("size:>1 size:>5", NOW)[0].size_min == 6
    assert parse_size("1x") is None and parse_size("") is None and parse_size("12") == 12


def test_windows():
    day0 = NOW - NOW % DAY
    p = parse("modified:yesterday", NOW)[0]
    assert (p.mtime_min, p.mtime_max) == ((day0 - DAY) * 10**9, (day0 - 1) * 10**9)
    assert parse("modified:7d", NOW)[0].mtime_min == (NOW - 7 * DAY) * 10**9
    assert parse("date:>2w", NOW)[0].mtime_max == (NOW - 14 * DAY) * 10**9
    assert parse("mtime:>2001-01-01", NOW)[0].mtime_min == 978_393_600 * 10**9
    assert parse("mtime:<2001-01-01", NOW)[0].mtime_max == (978_307_200 - 1) * 10**9
    p = parse("modified:2001-01-01", NOW)[0]
    assert p.mtime_max - p.mtime_min == (DAY - 1) * 10**9
    assert parse("modified:Today", NOW)[1] == "modified:Today"
    assert parse("modified:1970-01-01", NOW)[0].mtime_min is None  # consumed, not applied


def test_names_and_kinds():
    p, text = parse("KIND:Text kind:pdf EXT:Md name:Foo ext:a%b rest", NOW)
    assert p.mime_patterns == ["text/*", "application/pdf"] and p.extensions == ["md"] and p.name_parts == ["foo"]
    assert text == "ext:a%b rest"


def test_tokens():
    assert query_tokens("parseHTTPResponse2xx") == ["parse", "http", "response", "2", "xx"]
    assert query_tokens("snake_case-kebab") == ["snake", "case", "kebab"]
    assert query_tokens("Über café") == ["uber", "cafe"]
    assert query_tokens("---") == []


def test_phrases():
    assert phrases("targetFile re", True) == [Phrase(("target", "file")), Phrase(("re",), True)]
    assert phrases("--- foo", False) == [Phrase(("foo",))]
    assert phrases("foo ---", True) == [Phrase(("foo",))]
