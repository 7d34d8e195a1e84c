"""The corpus-to-topics flow (entry 1) as plain functions, shared by the
registered queries, the bench and the end-to-end topic model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.constants import RAKE_MAX_WORDS
from corpuslens.functions import text as T
from corpuslens.operators import filters as FL
from corpuslens.operators import postings as PO
from corpuslens.operators import text as TX
from corpuslens.operators import vocab as V
from corpuslens.session import stage
from corpuslens.sources import corpus as C


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(docs: DataFrame, text_cols: Sequence[str], stemmer: str = "s", remove: Sequence[str] | None = None,
            to_space: Sequence[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """A corpus table -> ``(doc_id, corpus, tokens, n_words, stems)``, one row
    per document; ids keep their type."""
    return with_stems(clean(docs, text_cols, remove, to_space, id_col), stemmer)


def clean(docs: DataFrame, text_cols: Sequence[str], remove: Sequence[str] | None = None,
          to_space: Sequence[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The first half of ``prepare``: ``(doc_id, corpus, n_words)``.

    Rows are worked on where they are read.  Only where the scan has fewer
    tasks than there are cores (a few files with large row groups) are the raw
    rows dealt out by id first."""
    if docs.rdd.getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism:
        docs = docs.repartition(id_col)
    docs = TX.build_corpus(docs, text_cols, id_col, remove=remove, to_space=to_space)
    return docs.select(F.col(id_col).alias("doc_id"), "corpus", T.word_count("corpus").alias("n_words"))


def with_stems(docs: DataFrame, stemmer: str) -> DataFrame:
    """The second half: tokens and stems of the cleaned text."""
    return TX.stem_tokens(TX.tokenize(docs).select("doc_id", "corpus", "tokens", "n_words"), stemmer)


def prepared_docs(spark: SparkSession, sf_dir: str, stemmer: str = "s") -> DataFrame:
    """``prepare`` on the whole ``documents`` table."""
    return prepare(read(spark, sf_dir, "documents"), ["source", "text"], stemmer)


@dataclass
class FlowParams:
    stemmer: str = "s"
    vocab_type: str = "word_rake"          # or "word"
    max_phrase_words: int = RAKE_MAX_WORDS
    score_lower: float = -10000
    score_upper: float = 10000
    n_min: int = 1                         # shortest and longest n-gram counted
    n_max: int = 5
    min_freq: int = 5
    max_freq: int | None = None            # count bound; then no fraction bound
    max_doc_fraction: float | None = 0.8
    phrase_pref: float = 1.0
    cc_threshold: float = 0.9
    cc_match: str = "substring"            # or "token"
    corr_threshold: float = 0.7
    corr_ties: str = "stem"                # or "both"
    n_topics: int = 2000
    rank_col: str = "cc_ratio"
    rank_ascending: bool = True
    stop_kind: str = "nltk-english"        # or "custom"
    stop_path: str | None = None
    stop_addons: Sequence[str] | None = None


class CorpusFlow:
    """Stages of the vocabulary reduction, each written when it is first
    asked for (columns in the shared folder; later stages read only theirs).
    Nothing is held on the driver except N and the mean document length."""

    def __init__(self, spark: SparkSession, docs: DataFrame, params: FlowParams | None = None,
                 stop_words: DataFrame | None = None, written: bool = False, tokens_of_corpus: bool = False):
        self.spark = spark
        self.p = params or FlowParams()
        self.docs = docs if written else stage(docs)
        self._tokens_of_corpus = tokens_of_corpus
        self.stop_words = stop_words if stop_words is not None else C.read_stop_words(
            spark, self.p.stop_kind, self.p.stop_path, self.p.stop_addons)
        self._held: dict[str, object] = {}

    @classmethod
    def of_tables(cls, spark: SparkSession, sf_dir: str, params: FlowParams | None = None) -> CorpusFlow:
        """The flow over the ``documents`` table."""
        return cls.of_corpus(read(spark, sf_dir, "documents"), ["source", "text"], params)

    @classmethod
    def of_corpus(cls, corpus: DataFrame, text_cols: Sequence[str], params: FlowParams | None = None,
                  id_col: str = "doc_id", remove: Sequence[str] | None = None,
                  to_space: Sequence[str] | None = None) -> CorpusFlow:
        """The flow over any corpus table, such as ``read_corpus`` gives.  Tokens
        and stems that are a column expression of the cleaned text are not
        written beside it."""
        p = params or FlowParams()
        docs = clean(corpus, text_cols, remove, to_space, id_col)
        if p.stemmer in TX.NATIVE_STEMMERS:
            return cls(corpus.sparkSession, with_stems(stage(docs), p.stemmer), p, written=True, tokens_of_corpus=True)
        return cls(corpus.sparkSession, with_stems(docs, p.stemmer), p, tokens_of_corpus=True)

    def _once(self, key, make):
        if key not in self._held:
            self._held[key] = make()
        return self._held[key]

    @property
    def stats(self) -> tuple[int, float]:
        return self._once("stats", lambda: FL.corpus_stats(self.docs))

    @property
    def vocab(self) -> DataFrame:
        return self._once("vocab", lambda: stage(V.create_vocabulary(
            self.docs, self.stop_words, self.p.stemmer, self.p.vocab_type, self.p.score_lower, self.p.score_upper,
            max_words=self.p.max_phrase_words, tokens_of_col=self._tokens_of_corpus)))

    @property
    def near(self) -> DataFrame:
        """The postings, and a few of n-grams that are in no vocabulary: every
        later step joins them to terms, which drops those."""
        return self._once("near", lambda: PO.written_near_postings(self.docs, self.vocab, self.p.n_min, self.p.n_max))

    @property
    def postings(self) -> DataFrame:
        return self._once("post", lambda: PO.drop_unknown(self.near, self.vocab))

    @property
    def totals(self) -> DataFrame:
        """Sums per term of ``near``, for all filters."""
        return self._once("totals", lambda: FL.written_totals(self.near, self.vocab.count()))

    @property
    def seen(self) -> DataFrame:
        """The totals of terms that are frequent enough: all that later steps need."""
        return self._once("seen", lambda: stage(self.totals.where(F.col("frequency") > self.p.min_freq)))

    def _restrict(self, terms: DataFrame) -> DataFrame:
        return FL.of_terms(self.near, terms.select(F.col("stem").alias("term")))

    @property
    def freq_flagged(self) -> DataFrame:
        """Not written: a second copy of the vocabulary, most of it rejected."""
        n, _ = self.stats
        return self._once("ff", lambda: FL.freq_filter(self.vocab, self.near, n, **self._bounds, totals=self.totals))

    @property
    def _bounds(self) -> dict:
        """Of the frequency filter."""
        fraction = None if self.p.max_freq is not None else self.p.max_doc_fraction
        return {"min_freq": self.p.min_freq, "max_freq": self.p.max_freq, "max_doc_fraction": fraction}

    @property
    def freq_kept(self) -> DataFrame:
        return self._once("fk", lambda: stage(FL.freq_kept(self.vocab, self.seen, self.stats[0], **self._bounds)))

    def most_frequent(self, n: int) -> DataFrame:
        """The ``n`` terms of the highest frequency, flagged."""
        return FL.top_frequent(self.vocab, self.totals, self.stats[0], n, **self._bounds)

    def cc_flagged_by(self, match: str) -> DataFrame:
        n, mean = self.stats
        return self._once(f"cf {match}", lambda: stage(FL.cluster_filter(
            self.freq_kept, self.docs, self.near, n, mean, self.p.phrase_pref,
            self.p.cc_threshold, match, totals=self.seen)))

    @property
    def cc_flagged(self) -> DataFrame:
        return self.cc_flagged_by(self.p.cc_match)

    @property
    def cc_kept(self) -> DataFrame:
        return FL.kept_only(self.cc_flagged)

    @property
    def correlated(self) -> DataFrame:
        """Pairs above the correlation threshold."""
        n, mean = self.stats
        return self._once("pairs", lambda: stage(FL.term_correlation(
            self._restrict(self.cc_kept), n, mean, self.p.corr_threshold)))

    def corr_flagged_by(self, ties: str) -> DataFrame:
        return self._once(f"crf {ties}", lambda: stage(FL.drop_correlated(self.cc_kept, self.correlated, ties)))

    @property
    def corr_flagged(self) -> DataFrame:
        return self.corr_flagged_by(self.p.corr_ties)

    @property
    def topics(self) -> DataFrame:
        return self._once("topics", lambda: stage(FL.topic_threshold(
            FL.kept_only(self.corr_flagged), self.p.n_topics, self.p.rank_col, self.p.rank_ascending)))

    @property
    def counts(self) -> DataFrame:
        """G1 from the postings (topics are part of the vocabulary, so their
        counts are there)."""
        return self._once("counts", lambda: stage(
            self.near.join(self.topics.select(F.col("stem").alias("term"), "topic_id"), "term")
            .select("doc_id", "n_words", "topic_id", F.col("tf").cast("double").alias("tf"))))


class Flows:
    """The flows of one registry, by application, folder and state of the
    files that they read."""

    def __init__(self):
        self._held: dict[tuple, CorpusFlow] = {}

    def of(self, spark: SparkSession, sf_dir: str) -> CorpusFlow:
        files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet")
        state = files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first()
        key = (spark.sparkContext.applicationId, sf_dir, *state)
        if key not in self._held:
            self._held[key] = CorpusFlow.of_tables(spark, sf_dir)
        return self._held[key]
