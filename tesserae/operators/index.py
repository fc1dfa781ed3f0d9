"""Inverted index and ranked search.

A written index of docs (id, name, body) is these tables, in a hash bucket of the term as partition where they have terms:

- postings (term, id, col, pos, colocated), by term and newest id first: phrases and prefixes
- hits (term, id, names, bodies, len), one row per term and document, newest first: words as they are
- vocab (term, doc, cnt, floors): document frequencies and counts; of a common term also how far down its newest documents
  reach: floors[k] is an id from which on it has 1024 * 2^k of them at least
- lengths (id, len), docs (id, name, body) by id, corpus (n_docs, avg_len, total_len, buckets), one row
- grams (gram, id), for an index written for substrings

A query reads only the buckets of its terms, and statistics are looked up, not counted. The bounded plan reads a common
term's newest hits only: the filter on a floor skips the row groups below it.

An index computed on the fly (Index.of) answers from the token arrays of each document instead: no posting is shuffled,
and only (id, length, frequencies) of the documents that match go on. Ranking is BM25 with the name weighing ten times the
body; ties go to the lower id.

Defined results: null names and bodies have no tokens (the document still counts); an empty query, or one without terms,
or a limit of 0 or less, gives no rows; ids are expected to be unique; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import index_tokens, trigrams
from ..plans.query import Phrase, condition, parse, phrases
from ..session import collect_within, exists, spread, staged, staging
from .batch import Asked, PhraseTree, best_of, phrases_of

WEIGHT_NAME, WEIGHT_BODY, K1, B = 10.0, 1.0, 1.2, 0.75
BUCKETS = 64
SPAN, FIRST_FLOOR = 1024, 1024  # ids that are counted together for floors; documents above the first
SCHEMAS = {
    "postings": "term string, id long, col int, pos int, colocated boolean, bucket int", "hits": "term string, id long, names int, bodies int, len int, bucket int",
    "vocab": "term string, doc long, cnt long, floors array<long>, bucket int", "grams": "id long, gram string, bucket int",
    "lengths": "id long, len long", "docs": "id long, name string, body string", "corpus": "n_docs long, avg_len double, total_len long, buckets int",
}
FETCHED = 1000  # winners up to this number are fetched by their ids


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    """The bucket of a term, as the engine's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def _length() -> Column:
    return (F.size("name") + F.size("body")).cast("long").alias("len")


def _exploded(arrays: DataFrame) -> DataFrame:
    """(term, id, col, pos, colocated, len) of all tokens, and of compounds as a whole."""
    cols = arrays.select("id", _length(), F.posexplode(F.array("name", "body")).alias("col", "tokens"))
    each = cols.select("id", "len", "col", F.posexplode("tokens").alias("pos", "t"))
    part, whole = F.struct(F.col("t.term").alias("term"), F.lit(False).alias("colocated")), F.struct(F.col("t.whole").alias("term"), F.lit(True).alias("colocated"))
    both = F.when(F.col("t.whole").isNull(), F.array(part)).otherwise(F.array(part, whole))
    return each.select("id", "len", "col", "pos", F.explode(both).alias("p")).select("p.term", "id", "col", "pos", "p.colocated", "len")


def _count(array: str, phrase: Phrase) -> Column:
    """Places of a token array where a phrase starts."""
    n = len(phrase.terms)

    def hit(x: Column, k: int) -> Column:
        t = phrase.terms[k]
        if phrase.prefix and k == n - 1:
            return x["term"].startswith(t) | F.coalesce(x["whole"].startswith(t), F.lit(False))
        return (x["term"] == t) | x["whole"].eqNullSafe(t)

    if n == 1:
        return F.size(F.filter(array, lambda x: hit(x, 0)))
    # neighbours side by side, so that the condition looks at one element only
    room = F.greatest(F.size(array) - n + 1, F.lit(0))
    rows = F.arrays_zip(*[F.slice(array, F.lit(k + 1), room).alias(f"t{k}") for k in range(n)])
    return F.size(F.filter(rows, lambda r: reduce(Column.__and__, [hit(r[f"t{k}"], k) for k in range(n)])))


def _part(tf: Column, df: Column) -> Column:
    """What one phrase adds to the score."""
    ratio = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5))
    return F.when(ratio > 0, ratio).otherwise(1e-6) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    docs: DataFrame
    files: DataFrame | None = None
    bucketed: bool = False
    arrays: DataFrame | None = None  # (id, name, body) as arrays of tokens
    hits: DataFrame | None = None
    terms: DataFrame | None = None
    grams: DataFrame | None = None
    stats: tuple[int, float, int] | None = None  # documents, average and total length
    buckets: int = BUCKETS
    _looked: dict[str, tuple[int, list[int]]] = field(default_factory=dict, repr=False)  # words of former queries

    # ---- building

    @classmethod
    def of(cls, docs: DataFrame, files: DataFrame | None = None) -> Index:
        """An index computed on the fly from docs (id, name, body)."""
        docs = spread(docs.select(F.col("id").cast("long").alias("id"), "name", "body"))
        # through a generator, so that the optimizer doesn't repeat the tokenizing in every expression on the arrays
        tokens = F.struct(index_tokens(F.col("name")).alias("name"), index_tokens(F.col("body")).alias("body"))
        arrays = docs.select("id", F.explode(F.array(tokens)).alias("t")).select("id", "t.name", "t.body")
        return cls(_exploded(arrays).drop("len"), arrays.select("id", _length()), docs, files, arrays=arrays)

    def bucketed_postings(self) -> DataFrame:
        return self._bucketed(self.postings, "term").repartitionByRange("bucket", "term", F.desc("id")).sortWithinPartitions("bucket", "term", F.desc("id"), "col", "pos")

    def _bucketed(self, df: DataFrame, term: str) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int"))

    def write(self, path: str, buckets: int = BUCKETS, substrings: bool = False) -> None:
        """All tables of the index under a folder. Ranges of (bucket, term, id) are tasks of their own, so that a common
        term is spread, and every file is sorted, so that ranges of terms and ids are pruned. Texts become tokens once."""
        self.buckets = buckets
        with staging(self.docs.sparkSession):
            arrays = staged(self.arrays)
            tokens = self._bucketed(_exploded(arrays), "term")
            postings = tokens.drop("len").repartitionByRange("bucket", "term", F.desc("id")).sortWithinPartitions("bucket", "term", F.desc("id"), "col", "pos")
            self._save(postings, path, "postings")
            lengths = arrays.select("id", _length())
            self._save(lengths, path, "lengths", False)
            counts = tokens.groupBy("bucket", "term", "id", F.col("len").cast("int").alias("len")).agg(F.count_if(F.col("col") == 0).cast("int").alias("names"), F.count_if(F.col("col") == 1).cast("int").alias("bodies"))
            hits = self._save(counts.repartitionByRange("bucket", "term", F.desc("id")).sortWithinPartitions("bucket", "term", F.desc("id")), path, "hits")
            vocab = hits.groupBy("bucket", "term").agg(F.count("*").alias("doc"), F.sum(F.col("names") + F.col("bodies")).alias("cnt"))
            self._save(vocab.join(self._floors(hits), ["bucket", "term"], "left").repartition("bucket").sortWithinPartitions("bucket", "term"), path, "vocab")
            self._save(lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), F.sum("len").alias("total_len")).withColumn("buckets", F.lit(buckets)), path, "corpus", False)
        self._save(self.docs.repartitionByRange("id").sortWithinPartitions("id"), path, "docs", False)
        if substrings:
            self.write_substrings(path)

    def write_substrings(self, path: str) -> None:
        """The trigrams of an index written there."""
        grams = self.docs.select("id", F.explode(F.array_distinct(F.concat(trigrams(F.col("name")), trigrams(F.col("body"))))).alias("gram"))
        self._save(self._bucketed(grams, "gram").repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id"), path, "grams")

    def _save(self, df: DataFrame, path: str, name: str, by_bucket: bool = True) -> DataFrame:
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy("bucket") if by_bucket else w).parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    def _floors(self, hits: DataFrame) -> DataFrame:
        """(bucket, term, floors) of terms with more than FIRST_FLOOR documents: hits are counted by spans of ids before they
        come together by term, newest span first."""
        spans = hits.groupBy("bucket", "term", F.floor(F.col("id") / SPAN).alias("span")).agg(F.count("*").alias("docs"))
        down = spans.withColumn("total", F.sum("docs").over(Window.partitionBy("bucket", "term").orderBy(F.desc("span"))))

        def reached(x: Column) -> Column:
            return F.when(x >= FIRST_FLOOR, F.floor(F.log2(x / FIRST_FLOOR) + 1e-9)).otherwise(-1).cast("int")

        new, old = reached(F.col("total")), reached(F.col("total") - F.col("docs"))
        steps = down.filter(new > old).select("bucket", "term", F.explode(F.sequence(old + 1, new)).alias("k"), (F.col("span") * SPAN).alias("low"))
        return steps.groupBy("bucket", "term").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "low"))), lambda x: x["low"]).alias("floors"))

    @classmethod
    def read(cls, spark: SparkSession, path: str, files: DataFrame | None = None) -> Index:
        t = {k: spark.read.schema(v).parquet(f"{path}/{k}") for k, v in SCHEMAS.items() if k != "grams" or exists(spark, f"{path}/{k}")}
        c = t["corpus"].first()
        return cls(t["postings"], t["lengths"], t["docs"], files, True, None, t["hits"], t["vocab"], t.get("grams"), (c.n_docs, c.avg_len or 0.0, c.total_len or 0), c.buckets)

    # ---- statistics

    def vocab(self) -> DataFrame:
        """(term, doc, cnt). Stored ones if there are; with token arrays each document gives its distinct terms and all its tokens, which are
        counted before the shuffle."""
        if self.terms is not None:
            return self.terms.select("term", "doc", "cnt")
        if self.arrays is not None:
            every = self.arrays.select(F.concat("name", "body").alias("t")).select(F.concat(F.transform("t", lambda x: x["term"]), F.filter(F.transform("t", lambda x: x["whole"]), lambda x: x.isNotNull())).alias("t"))
            each = every.select(F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("t")), F.struct(F.lit(1).alias("d"), F.array_distinct("t").alias("t")))).alias("s")).select("s.d", F.explode("s.t").alias("term"))
            return each.groupBy("term").agg(F.sum("d").alias("doc"), F.sum(1 - F.col("d")).alias("cnt"))
        return self.postings.groupBy("term").agg(F.count_distinct("id").alias("doc"), F.count("*").alias("cnt"))

    def corpus(self) -> DataFrame:
        if self.stats is not None:
            return self.docs.sparkSession.createDataFrame([self.stats], "n_docs long, avg_len double, total_len long")
        return self.lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), F.sum("len").alias("total_len"))

    def document_frequencies(self, text: str) -> DataFrame:
        """(term, doc) of every word of text as typed, lower-cased, 0 if absent: what the planner looks at."""
        words = list(dict.fromkeys(w.lower() for w in text.split()))
        spark = self.postings.sparkSession
        asked = spark.createDataFrame([(w,) for w in words], "term string")
        if self.terms is not None:
            hits = self._of_terms(self.terms, words).select("term", "doc")
        else:
            hits = self._of_terms(self.postings, words).groupBy("term").agg(F.count_distinct("id").alias("doc"))
        return asked.join(hits, "term", "left").select("term", F.coalesce("doc", F.lit(0)).alias("doc"))

    def is_common(self, text: str, common_df: int) -> bool:
        """Whether every word of text is in more than common_df documents; with one that is nowhere, nothing is scored."""
        if not text.split() or common_df <= 0:
            return False
        if self.terms is not None:
            return min(d for d, _ in self._lookup([w.lower() for w in text.split()]).values()) > common_df
        return (self.document_frequencies(text).agg(F.min("doc")).first()[0] or 0) > common_df

    def _lookup(self, words: list[str]) -> dict[str, tuple[int, list[int]]]:
        """word -> (document frequency, floors) from the stored vocabulary: a row per word that isn't known yet."""
        new = sorted({w for w in words if w not in self._looked})
        if new:
            if len(self._looked) > 10_000:
                self._looked.clear()
            found = {r.term: (r.doc, r.floors or []) for r in self._of_terms(self.terms, new).select("term", "doc", "floors").collect()}
            self._looked.update({w: found.get(w, (0, [])) for w in new})
        return {w: self._looked[w] for w in words}

    # ---- matching

    def _of_terms(self, table: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of some terms, from their buckets only."""
        if self.bucketed:
            table = table.filter(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in terms})))
        return table.filter(F.col("term").isin(terms) if len(terms) != 1 else F.col("term") == terms[0])

    def occurrences(self, phrase: Phrase, low: int | None = None) -> DataFrame:
        """(id, col, pos) where a phrase starts, in documents from id low on; segments of a compound count as neighbours."""
        found = None
        for k, term in enumerate(phrase.terms):
            prefix = phrase.prefix and k == len(phrase.terms) - 1
            rows = self.postings.filter(F.col("term").startswith(term)) if prefix else self._of_terms(self.postings, [term])
            rows = rows if low is None else rows.filter(F.col("id") >= low)
            rows = rows.select("id", "col", (F.col("pos") - k).alias("pos"))
            rows = rows.distinct() if prefix else rows
            found = rows if found is None else found.join(rows, ["id", "col", "pos"])
        return found

    def _matches(self, wanted: list[Phrase]) -> DataFrame:
        """(id, len, tf0, tf1, ...) of all documents from their token arrays."""
        tf = [(WEIGHT_NAME * _count("name", p) + WEIGHT_BODY * _count("body", p)).alias(f"tf{k}") for k, p in enumerate(wanted)]
        return self.arrays.select("id", _length(), *tf)

    def _scan_scores(self, wanted: list[Phrase], keep: DataFrame | None) -> DataFrame:
        found = self._matches(wanted)
        names = [f"tf{k}" for k in range(len(wanted))]
        corpus = found.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(t) > 0).alias(f"df{k}") for k, t in enumerate(names)])
        hits = found.filter(reduce(Column.__and__, [F.col(t) > 0 for t in names]))
        if keep is not None:
            hits = hits.join(keep, "id", "left_semi")
        hits = hits.withColumn("one", F.lit(1)).join(F.broadcast(corpus.withColumn("one", F.lit(1))), "one")
        return hits.select("id", reduce(Column.__add__, [_part(F.col(t), F.col(f"df{k}")) for k, t in enumerate(names)]).alias("score"))

    def _simple(self, wanted: list[Phrase]) -> bool:
        """Whether hits answer it: words as they are, without segments."""
        return self.hits is not None and bool(wanted) and all(len(p.terms) == 1 and not p.prefix for p in wanted)

    def _found(self, wanted: list[Phrase], low: int | None = None) -> DataFrame:
        """(id, len, tf0, tf1, ...) of the documents from id low on that have all words, joined from their hits."""
        found = None
        for k, p in enumerate(wanted):
            h = self._of_terms(self.hits, [p.terms[0]])
            h = h if low is None else h.filter(F.col("id") >= low)
            h = h.select("id", *(["len"] if found is None else []), (WEIGHT_NAME * F.col("names") + WEIGHT_BODY * F.col("bodies")).alias(f"tf{k}"))
            found = h if found is None else found.join(h, "id")
        return found

    def _weighed(self, found: DataFrame, wanted: list[Phrase]) -> DataFrame:
        """(id, score) of found rows with stored statistics."""
        n, average, _ = self.stats
        df = self._lookup([p.terms[0] for p in wanted])
        rows = found.withColumns({"n_docs": F.lit(n), "avg_len": F.lit(average)})
        return rows.select("id", reduce(Column.__add__, [_part(F.col(f"tf{k}"), F.lit(df[p.terms[0]][0])) for k, p in enumerate(wanted)]).alias("score"))

    def _frequencies(self, wanted: list[Phrase], keep: DataFrame | None) -> DataFrame:
        """(id, phrase, tf) of documents with all phrases, and df of each phrase over all documents."""
        tf = None
        for k, phrase in enumerate(wanted):
            one = self.occurrences(phrase).groupBy("id").agg(F.sum(F.when(F.col("col") == 0, WEIGHT_NAME).otherwise(WEIGHT_BODY)).alias("tf")).withColumn("phrase", F.lit(k))
            tf = one if tf is None else tf.unionByName(one)
        df = tf.groupBy("phrase").agg(F.count("*").alias("df"))  # one row per phrase of the query
        if keep is not None:
            tf = tf.join(keep, "id", "left_semi")
        return tf.join(F.broadcast(df), "phrase")

    def scores(self, wanted: list[Phrase], keep: DataFrame | None = None) -> DataFrame:
        """(id, score) of documents with all phrases (and in keep)."""
        if self.arrays is not None:
            return self._scan_scores(wanted, keep)
        if self._simple(wanted):
            found = self._found(wanted)
            return self._weighed(found if keep is None else found.join(keep, "id", "left_semi"), wanted)
        corpus = self.corpus().select("n_docs", "avg_len", F.lit(1).alias("one"))
        hits = self._frequencies(wanted, keep).join(self.lengths, "id").withColumn("one", F.lit(1)).join(F.broadcast(corpus), "one")
        return hits.groupBy("id").agg(F.sum(_part(F.col("tf"), F.col("df"))).alias("score"), F.count("*").alias("k")).filter(F.col("k") == len(wanted)).select("id", "score")

    def _floor(self, words: list[str], budget: int) -> int | None:
        """An id from which on one of the words has `budget` documents at least; None if all of each are needed."""
        if self.terms is None:
            return None
        k = max(0, (-(-budget // FIRST_FLOOR) - 1).bit_length())
        return min((f[k] for _, f in self._lookup(words).values() if k < len(f)), default=None)

    def newest(self, wanted: list[Phrase], budget: int, keep: DataFrame | None = None) -> DataFrame:
        """The `budget` highest ids among documents with all phrases."""
        return self._newest(wanted, budget, keep).select("id")

    def _newest(self, wanted: list[Phrase], budget: int, keep: DataFrame | None) -> DataFrame:
        if self.arrays is not None:
            hits = self._matches(wanted).filter(reduce(Column.__and__, [F.col(f"tf{k}") > 0 for k in range(len(wanted))]))
            hits = hits.join(keep, "id", "left_semi") if keep is not None else hits
            return hits.orderBy(F.desc("id")).limit(budget)

        def matches(low: int | None) -> DataFrame:
            if self._simple(wanted):
                out = self._found(wanted, low)
            else:
                out = reduce(lambda a, b: a.join(b, "id"), [self.occurrences(p, low).select("id").distinct() for p in wanted])
            out = out if keep is None else out.join(keep, "id", "left_semi")
            return out.orderBy(F.desc("id")).limit(budget)

        # common words: down to a floor first, and further until enough documents have all words
        exact = [t for p in wanted for k, t in enumerate(p.terms) if not (p.prefix and k == len(p.terms) - 1)]
        certain = self._simple(wanted) and len(wanted) == 1 and keep is None
        reach = budget
        while (low := self._floor(exact, reach)) is not None:
            out = matches(low)
            if certain or out.count() == budget:
                return out
            reach *= 8
        return matches(None)

    def bounded(self, wanted: list[Phrase], budget: int, keep: DataFrame | None = None) -> DataFrame:
        """(id, score) of the `budget` newest documents with all phrases."""
        new = self._newest(wanted, budget, keep)
        return self._weighed(new, wanted) if self._simple(wanted) else self.scores(wanted, new.select("id"))

    def contains(self, text: str, keep: DataFrame | None = None) -> DataFrame:
        """(id) of documents with every word of three or more characters as a substring of name or body, any case. With
        trigrams only documents that have all those of the words are looked at."""
        hits = self.docs
        words = [w.lower() for w in text.split() if len(w.encode()) >= 3]
        if self.grams is not None and (needed := sorted({w[k : k + 3] for w in words for k in range(len(w) - 2)})):
            rows = self.grams.filter(F.col("bucket").isin(sorted({bucket_of(g, self.buckets) for g in needed})) & F.col("gram").isin(needed))
            able = rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(needed)).select("id")
            hits = hits.join(able, "id", "left_semi")
        for low in words:
            hits = hits.filter(F.lower(F.coalesce("name", F.lit(""))).contains(low) | F.lower(F.coalesce("body", F.lit(""))).contains(low))
        hits = hits.select("id") if words else hits.select("id").limit(0)
        return hits.join(keep, "id", "left_semi") if keep is not None else hits

    # ---- search

    def search(self, query: str, limit: int = 6, now: int = 0, common_df: int = 20_000, budget: int = 2048, mode: str = "prefix", plan: str | None = None, deadline_s: float | None = None) -> DataFrame:
        """Hits (id, path, name, mime, score) of a search string, best first.

        Words in more than common_df documents take the bounded plan: exact last word, only the newest `budget` matches
        ranked. A full plan that takes longer than deadline_s is given up for the bounded one. Predicates alone list files in state 0, newest first, scored limit, limit-1, ..."""
        preds, text = parse(query, now)
        if self.files is None and preds.active:
            raise ValueError("predicates need files")
        if limit <= 0 or not (preds.active or text):
            return self._empty()
        if not text:
            return browse(self.files, query, limit, now)
        keep = self.files.filter(condition(preds)).select("id") if preds.active else None
        if mode == "substring":
            ranked = self.contains(text, keep).withColumn("score", F.lit(0.0))
        else:
            plan = plan or ("bounded" if self.is_common(text, common_df) else "full")
            wanted = phrases(text, prefix_last=plan == "full")
            if not wanted:
                return self._empty()
            exact = [t for p in wanted for k, t in enumerate(p.terms) if not (p.prefix and k == len(p.terms) - 1)]
            if self.terms is not None and exact and not all(d for d, _ in self._lookup(exact).values()):
                return self._empty()  # a word is nowhere
            ranked = self.bounded(wanted, max(limit, budget), keep) if plan == "bounded" else self.scores(wanted, keep)
        top = ranked.orderBy(F.desc("score"), "id").limit(limit)
        if self.files is None:
            rows = self.docs.select("id", F.lit(None).cast("string").alias("path"), "name", F.lit(None).cast("string").alias("mime"))
        else:
            rows = self.files.select("id", "path", "name", "mime")
        if limit <= FETCHED:  # the winners are looked up by their ids, which the scan is pruned by
            best = collect_within(top, deadline_s) if deadline_s is not None and plan == "full" else top.collect()
            if best is None:
                return self.search(query, limit, now, common_df, budget, mode, "bounded")
            rows = rows.filter(F.col("id").isin([r.id for r in best]))
            top = self.docs.sparkSession.createDataFrame([(r.id, r.score) for r in best], "id long, score double")
        return rows.join(top, "id").select("id", "path", "name", "mime", "score").orderBy(F.desc("score"), "id")

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query, phrase, k, term, segments, phrases) of queries (query, text): words split at blanks are phrases of their
        tokens; words without any are left out."""
        words = queries.select(F.col("query").cast("long").alias("query"), F.posexplode(F.split("text", r"\s+")).alias("phrase", "w"))
        cut = words.select("query", "phrase", F.transform(index_tokens(F.col("w")), lambda x: x["term"]).alias("t")).filter(F.size("t") > 0)
        count = F.count("*").over(Window.partitionBy("query"))
        return cut.withColumn("phrases", count.cast("int")).select("query", "phrase", F.posexplode("t").alias("k", "term"), F.size("t").alias("segments"), "phrases")

    def search_batch(self, queries: DataFrame | dict[int, str], limit: int = 10) -> DataFrame:
        """(query, rank, id, score): the best `limit` documents of each query (query, text), in one job; exact words, no
        predicates, ranked by scores to nine places.

        A table of queries takes one pass over all documents (`_in_one_pass`). A few from the program take one over the hits
        of their words, and over the postings of compound words, whose segments come together by the position of the first."""
        if not isinstance(queries, dict):
            return self._in_one_pass(queries, limit)
        queries = self.docs.sparkSession.createDataFrame(list(queries.items()), "query long, text string")
        asked = self.asked(queries)
        one = ["query", "phrase", "phrases"]
        if self.hits is None:
            simple, parts = None, asked
        else:
            words = asked.filter("segments = 1").select(*one, "term")
            hits = self.hits.select("term", "id", (WEIGHT_NAME * F.col("names") + WEIGHT_BODY * F.col("bodies")).alias("tf"))
            simple, parts = hits.join(words, "term").select(*one, "id", "tf"), asked.filter("segments > 1")
        places = self.postings.select("term", "id", "col", "pos").join(parts, "term").groupBy(*one, "segments", "id", "col", (F.col("pos") - F.col("k")).alias("start")).agg(F.count_distinct("k").alias("n")).filter("n = segments")
        tf = places.groupBy(*one, "id").agg(F.sum(F.when(F.col("col") == 0, WEIGHT_NAME).otherwise(WEIGHT_BODY)).alias("tf"))
        tf = tf if simple is None else tf.unionByName(simple)
        df = tf.groupBy("query", "phrase").agg(F.count("*").alias("df"))
        corpus = self.corpus().select("n_docs", "avg_len", F.lit(1).alias("one"))
        scored = tf.join(df, ["query", "phrase"]).join(self.lengths, "id").withColumn("one", F.lit(1)).join(F.broadcast(corpus), "one")
        total = scored.groupBy("query", "id").agg(F.round(F.sum(_part(F.col("tf"), F.col("df"))), 9).alias("score"), F.count("*").alias("found"), F.first("phrases").alias("phrases")).filter("found = phrases")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return total.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query", "rank", "id", "score")

    def _in_one_pass(self, queries: DataFrame, limit: int) -> DataFrame:
        """search_batch of a table. Equal queries are answered once, under the least number of them. The distinct phrases
        come to the driver and go to all tasks; their documents are staged, and again read with their frequencies."""
        spark = self.docs.sparkSession
        words = self.asked(queries).groupBy("query", "phrase").agg(F.sort_array(F.collect_list(F.struct("k", "term")))["term"].alias("terms"))
        sets = words.groupBy("query").agg(F.sort_array(F.collect_list("terms")).alias("terms"))
        sets = staged(sets.select("query", "terms", F.min("query").over(Window.partitionBy("terms")).alias("asked")))
        each = sets.filter("query = asked").select("asked", "terms").toArrow()
        number: dict[tuple[str, ...], int] = {}
        wanted = {q: [number.setdefault(tuple(p), len(number)) for p in terms] for q, terms in zip(each["asked"].to_pylist(), each["terms"].to_pylist())}
        if not wanted:
            return spark.createDataFrame([], "query long, rank int, id long, score double")
        arrays = self.arrays if self.arrays is not None else Index.of(self.docs).arrays
        found = arrays.select("id", _length(), "name", "body").mapInArrow(phrases_of(PhraseTree.of(list(number)), {"name": WEIGHT_NAME, "body": WEIGHT_BODY}), "id long, len long, phrases array<int>, tf array<double>")
        found = staged(found)
        n, average = found.agg(F.count("*"), F.avg("len")).first()
        counts = found.select(F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("df")).toArrow()
        df = np.zeros(len(number), np.int64)
        df[counts["phrase"].to_numpy()] = counts["df"].to_numpy()
        idf = np.log((n - df + 0.5) / (df + 0.5))
        best = found.mapInArrow(best_of(Asked.of(wanted, df), np.where(idf > 0, idf, 1e-6), average or 1.0, limit, K1, B), "asked long, id long, score double")
        rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))
        top = best.withColumn("rank", rank).filter(F.col("rank") <= limit)
        return sets.select("query", "asked").join(top, "asked").select("query", "rank", "id", "score")

    def _empty(self) -> DataFrame:
        return self.postings.sparkSession.createDataFrame([], "id long, path string, name string, mime string, score double")


def browse(files: DataFrame, query: str, limit: int, now: int = 0) -> DataFrame:
    """Files in state 0 that meet the predicates, newest first."""
    preds, _ = parse(query, now)
    top = files.filter((F.col("state") == 0) & condition(preds)).select("id", "path", "name", "mime", "mtime_ns").orderBy(F.desc("mtime_ns"), "id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("mtime_ns"), "id"))  # over the limited rows only
    return top.select("id", "path", "name", "mime", (F.lit(limit) - rank + 1).cast("double").alias("score"))
