"""Full-text and vector retrieval: tokens, BM25 over phrases and prefixes, cosine top-k, reciprocal-rank fusion."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphmill.sources.scratch import drop, materialize

# BM25 and rank-fusion constants, characters and words that queries lose.
K1, B, RRF_K, LEAST_IDF = 1.2, 0.75, 60, 1e-6
QUERY_MARKS, QUERY_WORDS = r'{}()[]^~*:"/\+-', ("AND", "OR", "NOT", "NEAR")


@cache
def accents() -> tuple[str, str]:
    """Letters of the Latin and Greek blocks that decompose into a letter and marks, and those letters."""
    pairs = []
    for code in range(0xC0, 0x2000):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Marks go, whether combined or not. Texts without a character that has any skip the translation."""
    old, new = accents()
    odd = text.rlike("[\\u00C0-\\u1FFF]")
    return F.when(odd, F.regexp_replace(F.translate(text, old, new), "\\p{Mn}", "")).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without accents."""
    return F.regexp_extract_all(strip_accents(F.lower(F.coalesce(text, F.lit("")))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def plain_tokens(text: str) -> list[str]:
    """tokens() of a driver-side string."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return [t for t in re.split(r"[\W_]+", flat) if t]


def sanitize(query: str) -> list[str]:
    """The query's terms: marks become blanks, operator words go."""
    for c in QUERY_MARKS:
        query = query.replace(c, " ")
    return [w for w in query.split() if w.upper() not in QUERY_WORDS]


@dataclass(frozen=True)
class Match:
    """Phrases that a text must all have; a prefix match has a single phrase whose last token may go on."""

    phrases: tuple[tuple[str, ...], ...]
    prefix: bool = False


def parse(query: str) -> Match | None:
    """One term is a prefix; of several, each is a phrase. None if nothing can be looked for."""
    terms = sanitize(query)
    phrases = tuple(p for p in (tuple(plain_tokens(t)) for t in terms) if p)
    return Match(phrases, len(terms) == 1) if phrases else None


def _both(same: Callable, token: str, last: bool, ok: Column, word: Column) -> Column:
    return F.coalesce(ok, F.lit(False)) & F.coalesce(same(word, token, last), F.lit(False))


def occurrences(words: Column, phrase: tuple[str, ...], prefix: bool) -> Column:
    """How often the phrase is in an array of tokens."""
    same = lambda w, t, last: w.startswith(t) if prefix and last else w == F.lit(t)
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: same(w, phrase[0], True)))
    # One array of "the phrase so far begins here" flags, narrowed by the words one, two, ... places further.
    here = F.transform(words, lambda w: same(w, phrase[0], False))
    for k, t in enumerate(phrase[1:], 1):
        follows = partial(_both, same, t, k == len(phrase) - 1)
        here = F.zip_with(here, F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), lambda ok, w: follows(ok, w))  # noqa: B023
    return F.size(F.filter(here, lambda ok: ok))


def bm25(docs: DataFrame, match: Match | None, id_col: str, text_cols: list[str], where: Column | None = None) -> DataFrame:
    """(id, score) of the docs that have all phrases, over the tokens of all text columns together.

    The form for texts without a TextIndex: one scan counts each doc's length and phrases, and writes these numbers. N, document frequencies and the
    mean length are of all docs; `where` filters results alone. Of phrases in over half of the docs the idf is
    LEAST_IDF.
    """
    if match is None:
        return docs.limit(0).select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"))
    words = words_of(text_cols)
    rows = docs.select(F.col(id_col).alias("id"), (where if where is not None else F.lit(True)).alias("shown"), words.alias("words"))
    rows = rows.select("id", "shown", F.size("words").alias("len"), *(occurrences(F.col("words"), p, match.prefix).alias(f"tf{i}") for i, p in enumerate(match.phrases)))
    rows = materialize(rows, "counts")
    n = range(len(match.phrases))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in n))
    hits = rows.where(F.col("shown"))
    for i in n:
        hits = hits.where(F.col(f"tf{i}") > 0)
    return scored(hits, stats, len(match.phrases))


def scored(hits: DataFrame, stats: DataFrame, phrases: int) -> DataFrame:
    """(id, score) of hits (id, len, tf0, tf1, ...) by one row of stats (n, mean, df0, df1, ...)."""
    score = F.lit(0.0)
    for i in range(phrases):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        tf = F.col(f"tf{i}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hits.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))


def top(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def words_of(text_cols: list[str]) -> Column:
    """The tokens of all text columns, one column after the other."""
    return F.flatten(F.array(*(tokens(F.col(c)) for c in text_cols))) if len(text_cols) > 1 else tokens(F.col(text_cols[0]))


#: Tokens that are grouped at a time; a longer document is grouped alone.
AT_A_TIME = 1 << 20


def occurring(ids: pa.Array, words: pa.ListArray, lengths: bool) -> list[pa.Array]:
    """The columns of by_document() for some documents: tokens are numbered, and sorted by document and number."""
    flat, lens = words.flatten().dictionary_encode(), np.diff(words.offsets.to_numpy())
    doc = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    number = flat.indices.to_numpy()
    order = np.argsort(doc * max(1, len(flat.dictionary)) + number, kind="stable")
    doc, number = doc[order], number[order]
    begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])][: len(doc)])
    end, more = np.r_[begin[1:], len(doc)][: len(begin)], len(lens) if lengths else 0
    rows = np.r_[doc[begin], np.arange(more)]
    term = flat.dictionary.take(pa.array(np.r_[number[begin], np.zeros(more, np.int64)], mask=np.r_[np.zeros(len(begin), bool), np.ones(more, bool)]))
    bounds = np.r_[0, end, np.full(more, len(doc))].astype(np.int32)
    return [term, ids.take(pa.array(rows)), pa.array(lens[rows], pa.int32()), pa.array(np.r_[end - begin, np.zeros(more, np.int64)], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(place[order], pa.int32()))]


def by_document(docs: DataFrame, id_col: str, text_col: str | list[str], lengths: bool = False) -> DataFrame:
    """(term, id, len, tf, positions) of each row's text by itself, without a shuffle; with lengths, each row besides has one
    without a term, from which its length can be read."""
    words = docs.select(F.col(id_col).alias("id"), words_of([text_col] if isinstance(text_col, str) else text_col).alias("words"))
    into = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", words.schema["id"].dataType), *T.StructType.fromDDL("len int, tf long, positions array<int>")])
    schema = to_arrow_schema(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, listed, at = batch.column("id"), batch.column("words"), 0
            ends = np.cumsum(np.diff(listed.offsets.to_numpy()))
            while at < batch.num_rows:
                held = ends[at - 1] if at else 0
                until = max(at + 1, int(np.searchsorted(ends, held + AT_A_TIME, "right")))
                columns = occurring(ids.slice(at, until - at), listed.slice(at, until - at), lengths)
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                at = until

    return words.mapInArrow(run, into)


def united(rows: DataFrame) -> DataFrame:
    """Postings in which rows of one id and length are one document."""
    return rows.groupBy("term", "id", "len").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def repeats(rows: DataFrame, *key: str) -> bool:
    return not rows.groupBy(*key).count().where("count > 1").isEmpty()


def postings(docs: DataFrame, id_col: str, text_col: str | list[str]) -> DataFrame:
    """(term, id, len, tf, positions): an index table; len is the document's. To be written clustered by term. Only if ids
    repeat, which is looked up at once, are tokens of several rows brought together."""
    rows = by_document(docs, id_col, text_col)
    return united(rows) if repeats(docs.select(F.col(id_col).alias("id")), "id") else rows


@dataclass(frozen=True)
class TextIndex:
    """Stored postings, in files that are ranges of (term, id), so that a search reads those of its terms alone; and the
    length of each document, searched or not."""

    postings: DataFrame
    lengths: DataFrame
    path: str

    @classmethod
    def write(cls, docs: DataFrame, id_col: str, text_cols: list[str], path: str) -> TextIndex:
        found = materialize(by_document(docs, id_col, text_cols, lengths=True), "by-document")
        found.where("term is null").select("id", "len").write.mode("overwrite").parquet(f"{path}/lengths")
        index = found.where("term is not null")
        again = repeats(docs.sparkSession.read.parquet(f"{path}/lengths"), "id", "len")
        cls.cluster(united(index) if again else index).write.mode("overwrite").parquet(f"{path}/postings")
        drop(found)
        return cls.read(docs.sparkSession, path)

    @staticmethod
    def cluster(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), path)

    def updated(self, docs: DataFrame, id_col: str, text_cols: list[str], gone: DataFrame, path: str) -> TextIndex:
        """A new index at path with docs in place of the documents with their ids, and without those of gone (id). Only
        the texts of docs are read."""
        rows = docs.select(F.col(id_col).alias("id"), *text_cols)
        old = rows.select("id").unionByName(gone.select("id")).distinct()
        keep = lambda df: df.join(old, "id", "left_anti").select(df.columns)
        keep(self.lengths).unionByName(rows.select("id", F.size(words_of(text_cols)).alias("len"))).write.mode("overwrite").parquet(f"{path}/lengths")
        new = postings(rows, "id", text_cols)
        self.cluster(keep(self.postings).unionByName(new.select(self.postings.columns))).write.mode("overwrite").parquet(f"{path}/postings")
        return self.read(docs.sparkSession, path)

    def totals(self) -> DataFrame:
        """One row: the number of documents (n) and their mean length."""
        return self.lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))

    def found(self, phrase: tuple[str, ...], prefix: bool) -> DataFrame:
        """(id, len, tf) of the documents that have the phrase; with prefix, its last token may go on."""
        out = None
        for k, token in enumerate(phrase):
            last = prefix and k == len(phrase) - 1
            rows = self.postings.where(F.col("term").startswith(token) if last else F.col("term") == token)
            if len(phrase) == 1:
                return rows.groupBy("id", "len").agg(F.sum("tf").alias("tf")) if last else rows.select("id", "len", "tf")
            # Where the phrase would begin for its word number k to stand here.
            begins = F.transform("positions", lambda p: p - k)  # noqa: B023
            rows = rows.groupBy("id", "len").agg(F.flatten(F.collect_list("positions")).alias("positions")) if last else rows
            rows = rows.select("id", "len", begins.alias(f"at{k}"))
            out = rows if out is None else out.join(rows.drop("len"), "id").withColumn("at0", F.array_intersect("at0", f"at{k}")).drop(f"at{k}").where(F.size("at0") > 0)
        return out.select("id", "len", F.size("at0").cast("long").alias("tf"))  # type: ignore[union-attr]

    def bm25(self, match: Match | None, among: DataFrame | None = None) -> DataFrame:
        """What bm25() gives for the indexed documents; among: (id) that may be in the result."""
        if match is None:
            return self.lengths.limit(0).select("id", F.lit(0.0).alias("score"))
        hits, stats = None, self.totals()
        for i, phrase in enumerate(match.phrases):
            rows = materialize(self.found(phrase, match.prefix).withColumnRenamed("tf", f"tf{i}"), "hits") if len(match.phrases) > 1 or among is not None else self.found(phrase, match.prefix).withColumnRenamed("tf", f"tf{i}")
            stats = stats.crossJoin(F.broadcast(rows.agg(F.count("*").alias(f"df{i}"))))
            hits = rows if hits is None else hits.join(rows.drop("len"), "id")
        if among is not None:
            hits = hits.join(among.select("id"), "id", "left_semi")
        return scored(hits, stats, len(match.phrases))


@dataclass(frozen=True)
class Segment:
    """A part of a text index that is never changed. number: its place in the order of updates; count and length: of its
    documents that are left."""

    index: TextIndex
    number: int
    count: int
    length: int


@dataclass(frozen=True)
class TextSegments(TextIndex):
    """A text index that grows by segments: an update writes the postings of its own documents, and a list of the ids that
    it replaces or removes, which are dead in all segments of lower numbers. Statistics are added up over segments. FANOUT
    segments of like size are merged into one without what is dead, so a document is rewritten a number of times that
    grows with the logarithm of their number."""

    segments: tuple[Segment, ...] = ()
    #: (number, ids that are dead in segments of lower numbers).
    dead: tuple[tuple[int, DataFrame], ...] = ()

    @classmethod
    def start(cls, docs: DataFrame, id_col: str, text_cols: list[str], path: str) -> TextSegments:
        """An index of docs, whose ids must be distinct, below path."""
        none = cls(*cls._tables(docs.sparkSession, ()), path)
        return none._grown(docs, id_col, text_cols, docs.select(F.col(id_col).alias("id")).limit(0))

    @staticmethod
    def _tables(spark: SparkSession, segments: tuple[Segment, ...]) -> tuple[DataFrame | None, DataFrame | None]:
        """All segments' postings and lengths, dead ones included."""
        both: list[DataFrame | None] = [None, None]
        for s in segments:
            for k, part in enumerate((s.index.postings, s.index.lengths)):
                both[k] = part if both[k] is None else both[k].unionByName(part)
        return both[0], both[1]

    def alive(self, segment: Segment, rows: DataFrame) -> DataFrame:
        """Of a segment's rows (id, ...) those that no later update has replaced."""
        for number, ids in self.dead:
            if number > segment.number:
                rows = rows.join(ids, "id", "left_anti").select(rows.columns)
        return rows

    def updated(self, docs: DataFrame, id_col: str, text_cols: list[str], gone: DataFrame, path: str | None = None) -> TextSegments:
        """The index with docs in place of the documents with their ids, and without those of gone (id). Written are docs'
        postings, the ids, and now and then merged segments; path is that of start."""
        return self._grown(docs, id_col, text_cols, gone)._merged()

    def _grown(self, docs: DataFrame, id_col: str, text_cols: list[str], gone: DataFrame) -> TextSegments:
        number = max((s.number for s in self.segments), default=-1) + 1
        at = f"{self.path}/segment-{number}-{uuid.uuid4().hex[:8]}"
        index = TextIndex.write(docs, id_col, text_cols, at)
        index.lengths.select("id").unionByName(gone.select(F.col("id"))).distinct().write.parquet(f"{at}/dead")
        ids = docs.sparkSession.read.parquet(f"{at}/dead")
        kept = []
        for s in self.segments:
            lost = self.alive(s, s.index.lengths).join(ids, "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            kept.append(Segment(s.index, s.number, s.count - lost[0], s.length - lost[1]))
        n, length = index.lengths.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        segments = (*kept, Segment(index, number, n, length))
        return TextSegments(*self._tables(docs.sparkSession, segments), self.path, segments, (*self.dead, (number, ids)))

    def _merged(self) -> TextSegments:
        """This, or with FANOUT segments of one tier as one."""
        tiers: dict[int, list[Segment]] = {}
        for s in self.segments:
            tiers.setdefault(int(math.log(max(1, s.count), FANOUT)), []).append(s)
        full = next((t for _, t in sorted(tiers.items()) if len(t) >= FANOUT), None)
        if full is None:
            return self
        at = f"{self.path}/merged-{uuid.uuid4().hex[:12]}"
        for label in ("postings", "lengths"):
            rows = None
            for s in full:
                part = self.alive(s, getattr(s.index, label))
                rows = part if rows is None else rows.unionByName(part)
            (self.cluster(rows) if label == "postings" else rows).write.parquet(f"{at}/{label}")  # type: ignore[arg-type, union-attr]
        spark = self.postings.sparkSession
        one = Segment(TextIndex.read(spark, at), max(s.number for s in full), sum(s.count for s in full), sum(s.length for s in full))
        segments = tuple(sorted((*(s for s in self.segments if s not in full), one), key=lambda s: s.number))
        first = segments[0].number
        return TextSegments(*self._tables(spark, segments), self.path, segments, tuple(d for d in self.dead if d[0] > first))._merged()

    def totals(self) -> DataFrame:
        n, length = sum(s.count for s in self.segments), sum(s.length for s in self.segments)
        return self.postings.sparkSession.createDataFrame([(n, length / n if n else None)], "n long, mean double")

    def found(self, phrase: tuple[str, ...], prefix: bool) -> DataFrame:
        out = None
        for s in self.segments:
            rows = self.alive(s, s.index.found(phrase, prefix))
            out = rows if out is None else out.unionByName(rows)
        return out  # type: ignore[return-value]


#: Segments of like size that are merged into one.
FANOUT = 4


def cosine(vector: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, norm * F.lit(sum(float(x) ** 2 for x in query) ** 0.5))


def vector_top(vectors: DataFrame, query: list[float], limit: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): exact cosine top-k; rows whose vector is null, zero or of another length don't take part."""
    found = vectors.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), cosine(F.col(vector_col), query).alias("score"))
    return top(found.where("score is not null and not isnan(score)"), limit)


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """(id, score, position) of the first `limit`, counted from 1; the window sees no more rows than those."""
    return top(rows, limit).withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(lists: list[DataFrame], limit: int) -> DataFrame:
    """(id, score): the sum over lists of 1 / (RRF_K + position), each list's first `limit` taking part."""
    out = None
    for rows in lists:
        part = ranked(rows, limit).select("id", (1 / (RRF_K + F.col("position"))).alias("score"))
        out = part if out is None else out.unionByName(part)
    return top(out.groupBy("id").agg(F.sum("score").alias("score")), limit)  # type: ignore[union-attr]
