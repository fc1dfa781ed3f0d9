"""Queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .encode import token_ids
from .encodings import LanguageModel, mended
from .lookalike import plain_forms
from .mixing import bounds, mix, shares
from .nearcopies import near_copies, near_copy_groups, near_copy_pairs
from .splitting import coverage, split, split_report
from .termcounts import marked_counts, term_counts
from .truncation import OTHER_MEASURES, PLAIN_MEASURES, exposed_limits, source_shares, truncated


def _texts(spark, d):
    """(texts: origin, rec_id, source, text; declared: source, value)."""
    options = table(spark, d, "extract_options")
    results = table(spark, d, "extract_results").select(F.lit("extract_results").alias("origin"), F.col("result_id").alias("rec_id"), "source", "text")
    docs = table(spark, d, "docs").select("id", "body_z").filter("body_z is not null and body_z <> ''")
    # the folders of the options, a fixed table of settings: the longest that holds the path gives the source
    roots = options.filter("root is not null").groupBy("root").agg(F.min("source").alias("source")).collect()
    source = F.lit(None).cast("string")
    for r in sorted(roots, key=lambda r: (len(r["root"]), r["root"])):
        source = F.when(F.col("path").startswith(r["root"].rstrip("/") + "/"), r["source"]).otherwise(source)
    known = table(spark, d, "files").select("id", source.alias("source"))
    bodies = docs.join(known, "id", "left").select(F.lit("docs").alias("origin"), F.col("id").alias("rec_id"), "source", F.col("body_z").alias("text"))
    return results.unionByName(bodies), options.select("source", F.col("max_text_bytes").alias("value"))


def _cut(spark, d):
    return truncated(*_texts(spark, d))


def p1_found(spark, d):
    return _cut(spark, d).filter("truncated").select("origin", "rec_id")


def p1_shares(spark, d):
    return source_shares(_cut(spark, d))


def p1_evidence(spark, d):
    """What speaks against each truncated record: the limit it is as long as, in which measure, or its ending."""
    return _cut(spark, d).filter("truncated").select("origin", "rec_id", "source", "evidence", "measure", "value", "form")


def p1_limits(spark, d):
    return exposed_limits(*_texts(spark, d))


def p2_found(spark, d):
    return near_copy_pairs(table(spark, d, "docs"))


def p2_groups(spark, d):
    return near_copy_groups(table(spark, d, "docs"))


def p2_links(spark, d):
    return near_copies(table(spark, d, "docs"))[1]


def _garbled(spark, d, results):
    return mended(results, "result_id", "text", LanguageModel.fit(table(spark, d, "documents")))


def p3_found(spark, d):
    """Texts whose form differs are held against the test of p5: a garbled text is no case here."""
    names = plain_forms(table(spark, d, "files"), "id", "name").filter("changed").select(F.lit("name").alias("field"), "rec_id")
    results = table(spark, d, "extract_results")
    texts = plain_forms(results, "result_id", "text").filter("changed").select("rec_id")
    suspects = results.join(texts.withColumnRenamed("rec_id", "result_id"), "result_id", "left_semi")
    clear = _garbled(spark, d, suspects).filter("not garbled").select(F.lit("text").alias("field"), "rec_id")
    return names.unionByName(clear)


def p3_forms(spark, d):
    names = plain_forms(table(spark, d, "files"), "id", "name").select(F.lit("name").alias("field"), "rec_id", "form", "changed")
    texts = plain_forms(table(spark, d, "extract_results"), "result_id", "text").select(F.lit("text").alias("field"), "rec_id", "form", "changed")
    return names.unionByName(texts)


def _marked(spark, d):
    fields = {"body_z": (table(spark, d, "docs"), "body_z", False), "mime": (table(spark, d, "files"), "mime", True)}
    return marked_counts(fields, table(spark, d, "term_limits"))


def p4_found(spark, d):
    return _marked(spark, d).filter("mark is not null").select("field", "term", "mark")


def p4_terms(spark, d):
    return _marked(spark, d)


def p4_ngrams(spark, d):
    """All runs of one to three terms, those of a single record too."""
    return term_counts(table(spark, d, "docs"), "body_z", 3)


def p5_found(spark, d):
    return _garbled(spark, d, table(spark, d, "extract_results")).filter("garbled").select(F.col("rec_id").alias("result_id"))


def p5_mended(spark, d):
    return _garbled(spark, d, table(spark, d, "extract_results")).filter("garbled").withColumnRenamed("rec_id", "result_id")


def p6_ids(spark, d):
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p7_mix(spark, d):
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark, d):
    return shares(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p7_bounds(spark, d):
    targets = table(spark, d, "mix_targets")
    return bounds(p7_mix(spark, d), targets)


def p8_pieces(spark, d):
    return split(table(spark, d, "documents"), table(spark, d, "split_limits"))


def p8_coverage(spark, d):
    return coverage(p8_pieces(spark, d), table(spark, d, "documents"), table(spark, d, "split_limits"))


def p8_report(spark, d):
    return split_report(p8_pieces(spark, d))


_FUNCTIONS = (
    p1_found, p1_shares, p1_evidence, p1_limits, p2_found, p2_groups, p2_links, p3_found, p3_forms, p4_found, p4_terms, p4_ngrams,
    p5_found, p5_mended, p6_ids, p7_mix, p7_shares, p7_bounds, p8_pieces, p8_report, p8_coverage,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_TERMS = """
select id, lower(t) as term from (select id, unnest(regexp_extract_all(body_z, '[\\p{L}\\p{N}]+')) as t from docs)
"""
_COUNTS = f"""
select 'body_z' as field, term, count(*) as occurrences, count(distinct id) as records from ({_TERMS}) group by term
union all
select 'mime', mime, count(*), count(*) from files where mime is not null and mime <> '' group by mime
"""
_MARKED = f"""
with n as (select 'body_z' as field, count(*) as total from docs where body_z <> ''
           union all select 'mime', count(*) from files where mime <> '')
select c.field, c.term, c.occurrences::bigint as occurrences, c.records::bigint as records,
       case when c.records < l.min_records then 'rare' when 100 * c.records > l.max_percent * n.total then 'common' end as mark
from ({_COUNTS}) c join n using (field) join term_limits l using (field)
"""
_SETS = """
t as (select id, list_transform(regexp_extract_all(body_z, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) as w from docs),
s as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as sh from t where len(w) >= 20),
n as (select id, count(*) as n from s group by id),
p as (select a.id as id_a, b.id as id_b, count(*) as common from s a join s b on a.sh = b.sh and a.id < b.id
      where a.sh in (select sh from s group by sh having count(*) > 1) group by 1, 2)
"""
_CLASSES = _SETS + """,
c as (select id, min(id) over (partition by key) as rep from (select id, list_sort(list(sh)) as key from s group by id)),
l as (select id_a, id_b, x.n::int as n_a, y.n::int as n_b, common::int as common from p join n x on x.id = id_a join n y on y.id = id_b
      where 3 * common >= x.n + y.n and id_a in (select rep from c) and id_b in (select rep from c))
"""
_GRAMS = " union all ".join(
    f"select id, {d} as n, unnest(list_transform(range(1, len(w) - {d - 2}), lambda i: array_to_string(w[i:i + {d - 1}], ' '))) as term from t where len(w) >= {d}" for d in (1, 2, 3)
)

_MEASURES = """
chars as chars, bytes as bytes, chars + four as utf16, chars + lf as crlf_chars, bytes + lf as crlf_bytes,
chars + 4 * amp + 3 * angle as entity_chars, bytes + 4 * amp + 3 * angle as entity_bytes,
chars + 4 * amp + 3 * angle + 5 * quote as entity_quote_chars, bytes + 4 * amp + 3 * angle + 5 * quote as entity_quote_bytes,
chars + lf + quote + slash + tabs as json_chars, bytes + lf + quote + slash + tabs as json_bytes,
chars + lf + quote + slash + tabs + 5 * wide + 6 * four as json_ascii
"""


def _spikes_sql(lengths: str, measures: tuple[str, ...]) -> str:
    return f"""select source, measure, value, n from (
      select *, (sum(n) over (partition by source, measure order by value range between 30 preceding and 30 following) - n) / 60.0 as near
      from (select source, measure, value, count(*) as n from (unpivot (select source, {', '.join(measures)} from {lengths}) on {', '.join(measures)} into name measure value value) group by 1, 2, 3))
      join (select source, count(*) as size from {lengths} group by 1) using (source)
      where n >= 5 and n >= 0.002 * size and n >= 6 * (near + 0.25)"""


_LIMITS = f"""
with roots as (select root, min(source) as source from extract_options where root is not null group by root),
owned as (select d.id, d.body_z as text, arg_max(r.source, (length(r.root), r.root)) as source
  from docs d left join files f on f.id = d.id left join roots r on starts_with(f.path, rtrim(r.root, '/') || '/') group by d.id, d.body_z),
texts as (select distinct coalesce(source, '') as source, text from (select source, text from extract_results union all select source, text from owned) where text <> ''),
counted as (select source, length(text) as chars, strlen(text) as bytes,
  length(text) - length(replace(text, chr(10), '')) as lf, length(text) - length(replace(text, '&', '')) as amp,
  length(text) - length(regexp_replace(text, '[<>]', '', 'g')) as angle, length(text) - length(replace(text, '"', '')) as quote,
  length(text) - length(replace(text, chr(92), '')) as slash, length(text) - length(regexp_replace(text, '[\\t\\r]', '', 'g')) as tabs,
  length(text) - length(regexp_replace(text, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) as four,
  length(text) - length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')) as wide from texts),
lengths as (select source, {_MEASURES} from counted),
known as (select distinct coalesce(source, '') as source, max_text_bytes as value from extract_options where max_text_bytes is not null),
plain as ({_spikes_sql("lengths", PLAIN_MEASURES)}),
simple as (select source, measure, value from plain union select source, 'bytes', value from known),
rest as (select * from lengths l where not exists (from simple s where s.source = l.source and (s.measure = 'chars' and s.value = l.chars or s.measure = 'bytes' and s.value = l.bytes))),
other as ({_spikes_sql("rest", OTHER_MEASURES)})
select nullif(source, '') as source, measure, value::int as value, n::bigint as n, (source, value) in (select (source, value) from known) as declared
from (select * from plain union all select * from other)
"""

ORACLES: dict[str, str] = {
    "p1_limits": _LIMITS,
    "p7_bounds": "select t.source, true as capped, true as rounded, true as on_goal from mix_targets t where t.source in (select source from documents where text <> '')",
    "p8_coverage": "select limit_name, true as within_limit, true as overlapping, true as whole, true as same_text from split_limits",
    "p2_found": f"with {_SETS} select id_a, id_b from p join n x on x.id = id_a join n y on y.id = id_b where 3 * common >= x.n + y.n",
    "p2_links": f"with {_CLASSES} select * from l",
    "p2_groups": f"""with recursive {_CLASSES},
e as (select id_a as x, id_b as y from l union all select id_b, id_a from l),
r(a, b) as (select rep, rep from c union select r.a, e.y from r join e on e.x = r.b),
g as (select a as rep, min(b) as group_id from r group by a),
k as (select x as rep, count(*) as links from e group by x)
select c.id, g.group_id, c.rep, coalesce(k.links, 0)::bigint as links from c join g using (rep) left join k using (rep)""",
    "p4_found": f"select field, term, mark from ({_MARKED}) where mark is not null",
    "p4_terms": _MARKED,
    "p4_ngrams": f"""
with t as (select id, list_transform(regexp_extract_all(body_z, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) as w from docs), g as ({_GRAMS})
select term, n::int as n, count(*)::bigint as occurrences, count(distinct id)::bigint as records from g group by term, n
""",
}
