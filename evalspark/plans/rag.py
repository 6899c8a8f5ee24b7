"""Questions to answers to scores, for one or many experiments at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import hooks
from evalspark.operators import answering, metrics
from evalspark.operators.chunking import BASE, with_chunk_index
from evalspark.operators.embedding import TFIDF, Embed, embed_with
from evalspark.operators.lookups import covering_ranges, narrowed
from evalspark.operators.mmr import mmr
from evalspark.operators.postings import fill_up, topk_postings
from evalspark.operators.textsearch import CHUNK, topk_chunks, with_idf_of_chunks
from evalspark.session import stage
from evalspark.settings import Settings
from evalspark.sources.tables import Index, load_or_build_index, through_cache

def embed_for(index: Index, settings: Settings) -> Embed:
    """Questions, answers and claims go through the cache of the index, as its chunks did."""
    cached = (lambda texts: through_cache(texts, "text", settings, index.cache)) if index.cache else None
    return embed_with(settings, index.terms, index.experiments, cached)


def nearest(questions: DataFrame, index: Index, settings: Settings, k: int) -> DataFrame:
    """The top ``k`` of every question by the backend of the settings; word searches are filled up
    to ``k`` with chunks that share no word."""
    asked = embed_for(index, settings)(questions, ["qid"], "question")
    if settings.embedding_provider == TFIDF:
        asked = with_idf_of_chunks(stage(asked, asked.sparkSession), ["qid"], index.terms)
    if settings.search_backend == "postings":
        if index.postings is None:
            raise ValueError("this index was built without postings: build it with these settings")
        found = topk_postings(asked, index.postings, k)
    else:
        found = topk_chunks(asked, index.vectors, k)
    if settings.embedding_provider != TFIDF:
        return found
    every = questions.select(F.explode(F.array(*map(F.lit, index.experiments))).alias("experiment"), "qid")
    return fill_up(found, every, index.chunks, index.offsets, k)


def retrieve(questions: DataFrame, index: Index, settings: Settings) -> DataFrame:
    """``experiment, qid, rank, doc_id, pos, sim`` under every experiment of the index."""
    if settings.search_type == "similarity":
        return nearest(questions, index, settings, settings.k)
    pool = nearest(questions, index, settings, settings.fetch_k).withColumnRenamed("experiment", "cell")
    pool = stage(pool, pool.sparkSession)
    vectors = narrowed(index.vectors, covering_ranges(pool))
    if settings.embedding_provider == TFIDF:
        near = pool.select(F.col("cell").alias("experiment"), "doc_id", "pos").distinct()
        vectors = with_idf_of_chunks(vectors.join(near, CHUNK), ["doc_id", "pos"], index.terms)
    vectors = vectors.withColumnRenamed("experiment", "cell")
    chosen = mmr(pool, vectors, ["doc_id", "pos"], settings.k, settings.lambda_mult)
    return chosen.withColumnRenamed("cell", "experiment")


def with_text(hits: DataFrame, index: Index, numbered: bool = False) -> DataFrame:
    """Add text and file name of the chunks that were hit, and on request ``chunk_index``.

    Hits are few and staged, so Spark sees their size and leaves the big tables in
    place. Each big table meets the hits on its own for that reason, and its scan skips what
    lies outside the ranges of their ids.
    """
    hits = stage(hits, hits.sparkSession)
    ranges = covering_ranges(hits)
    found = hits.join(narrowed(index.chunks, ranges).select(*CHUNK, "filename", "chunk_text"), CHUNK)
    if not numbered:
        return found
    numbers = with_chunk_index(hits.select(*CHUNK), narrowed(index.offsets, ranges)).distinct()
    return found.join(numbers, CHUNK)


def answer(answerable: DataFrame, settings: Settings) -> DataFrame:
    """Add ``answer``, by the built-in extraction or by a registered writer with the model, temperature
    and length of the settings. A chat adds ``error`` too: why a question has no answer."""
    if settings.llm_provider == "extractive":
        answers = answering.extractive_answers(answerable, settings.answer_threshold)
    else:
        prompts = answering.prompts(answerable).select(*answering.QUESTION, "system", "human")
        options = hooks.ChatOptions(settings.llm_model, settings.temperature, settings.max_tokens)
        written = hooks.writer(settings.llm_provider, options)(prompts)
        kept = ["error"] if "error" in written.columns else []
        # Read twice below, and answers cost money.
        answers = stage(written, written.sparkSession).select(
            *answering.QUESTION, answering.strip(F.col("answer")).alias("answer"), *kept
        )
    return answerable.join(answers, answering.QUESTION)


def answer_all(questions: DataFrame, hits: DataFrame, experiments: Sequence[str], settings: Settings) -> DataFrame:
    """Records of all questions under each experiment, also those that found nothing."""
    named = F.explode(F.array(*map(F.lit, experiments))).alias("experiment")
    asked = questions.select(named, "*")
    gathered = answering.contexts_by_query(asked, hits)
    return answer(stage(gathered, questions.sparkSession), settings)


def score(records: DataFrame, index: Index, settings: Settings, judge: str | None = None) -> DataFrame:
    """``experiment, qid, metric, score``; records are staged, as each metric reads them."""
    return metrics.score_long(
        stage(records, records.sparkSession),
        embed_for(index, settings),
        settings.metrics,
        hooks.judge(judge) if judge else None,
        settings.support_threshold,
    )


class Rag:
    """Build once, then ask: the entry point for interactive use."""

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()
        self.index: Index | None = None

    def build(
        self, docs: DataFrame, root: str | None = None, rebuild: bool = False, corpus: str | None = None
    ) -> "Rag":
        """Index ``docs``, or load the index saved for the same corpus and settings.

        ``doc_id`` is a whole number: searches carry it in numpy blocks.
        """
        if dict(docs.dtypes).get("doc_id") not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError("doc_id has to be a column of whole numbers")
        if "filename" not in docs.columns:
            docs = docs.withColumn("filename", F.lit(None).cast("string"))
        self.index = load_or_build_index(docs, [(BASE, self.settings)], root, rebuild, corpus)
        return self

    def _built(self) -> Index:
        if self.index is None:
            raise RuntimeError("no index yet: call build() before asking")
        return self.index

    def batch_query(self, questions: DataFrame) -> DataFrame:
        """Answers for ``questions(qid, question, ...)``; sort by ``qid`` for input order."""
        index = self._built()
        hits = with_text(retrieve(questions, index, self.settings), index, numbered=True)
        return answer_all(questions, hits, [BASE], self.settings)

    def query(self, question: str) -> DataFrame:
        """The same plan for one question."""
        spark: SparkSession = self._built().terms.sparkSession
        return self.batch_query(spark.createDataFrame([(0, question)], "qid bigint, question string"))

    def evaluate(self, items: DataFrame, judge: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``(records, scores per question, aggregates)`` of ``items(qid, question, ground_truth)``."""
        records = stage(self.batch_query(items), items.sparkSession)
        scores = stage(score(records, self._built(), self.settings, judge), items.sparkSession)
        wide = metrics.score_wide(records, scores, self.settings.metrics)
        return records, wide, metrics.aggregate_scores(wide)
