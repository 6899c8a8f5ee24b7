
from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
from evalspark import hooks  # noqa: E402
from evalspark.functions import text as tx  # noqa: E402
from evalspark.functions.vectors import as_double, normalize  # noqa: E402
from evalspark.operators import answering, cache, chunking, densesearch, metrics  # noqa: E402
from evalspark.operators.mmr import mmr as mmr_pick  # noqa: E402
from evalspark.plans import rag, sweeps  # noqa: E402
from evalspark.session import shared_dir, ship, stage  # noqa: E402
from evalspark.settings import Settings  # noqa: E402
from evalspark.sources import evalset, files  # noqa: E402
from evalspark.sources.tables import Index, file_mark, load_or_build_index  # noqa: E402

try:
    import corpus_pipeline
    from evalspark.llm import queries as llm
except ImportError:  # the subpackage is optional, and only here
    llm = None

# Windows have a SQL twin; the recursive split, the default, has not.
SETTINGS = Settings(splitter="windows")
SMALLEST = "/root/testdata/sf0.001"
MODEL = "letters"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def path_column() -> Column:
    return F.concat(
        F.lit("/"), F.col("source"), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/Doc."), F.col("doc_id"), F.lit(".TXT")
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text, filename``, cleaned where they are read."""
    raw = table(spark, folder, "documents").select("doc_id", "text", path_column().alias("path"))
    return raw.select(
        "doc_id", tx.clean_text(F.col("text")).alias("text"), tx.file_name(F.col("path")).alias("filename")
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """The text of an item asks for it and is the truth."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"), F.col("text").alias("ground_truth")
    )


def brief_items(spark: SparkSession, folder: str) -> DataFrame:
    """The first words of an item ask for it, the whole of it is the truth."""
    return items(spark, folder).withColumn("question", F.array_join(F.slice(F.split("question", " "), 1, 16), " "))


def windows(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_windows(documents(spark, folder))


def index_root(spark: SparkSession) -> str:
    """An index is shared by the queries of one session, and built anew in the next."""
    return f"{shared_dir(spark)}/index-{spark.sparkContext.applicationId}"


def saved(spark: SparkSession, folder: str) -> dict[str, str]:
    """Where indexes are, and which state of the documents they must be of."""
    return {"root": index_root(spark), "corpus": file_mark(table(spark, folder, "documents"))}


def index(spark: SparkSession, folder: str) -> Index:
    return load_or_build_index(documents(spark, folder), [(chunking.BASE, SETTINGS)], **saved(spark, folder))


def hits(spark: SparkSession, folder: str, settings: Settings = SETTINGS) -> DataFrame:
    return rag.retrieve(items(spark, folder), index(spark, folder), settings)


def hits_with_text(spark: SparkSession, folder: str, asked: Callable = items) -> DataFrame:
    found = index(spark, folder)
    return rag.with_text(rag.retrieve(asked(spark, folder), found, SETTINGS), found)


def records(spark: SparkSession, folder: str, found: Index | None = None, asked: Callable = items) -> DataFrame:
    found = found or index(spark, folder)
    texts = rag.with_text(rag.retrieve(asked(spark, folder), found, SETTINGS), found)
    return rag.answer_all(asked(spark, folder), texts, [chunking.BASE], SETTINGS)


def scored(spark: SparkSession, folder: str, names: tuple[str, ...], asked: Callable = items) -> DataFrame:
    found = index(spark, folder)
    return rag.score(records(spark, folder, found, asked), found, SETTINGS.variant({"eval.metrics": names}))


def all_scores(spark: SparkSession, folder: str, asked: Callable = items) -> DataFrame:
    return stage(scored(spark, folder, SETTINGS.metrics, asked), spark)


def aggregates(spark: SparkSession, folder: str, asked: Callable = items) -> DataFrame:
    scores = all_scores(spark, folder, asked)
    return metrics.aggregate_scores(metrics.score_wide(scores.select("experiment", "qid").distinct(), scores))


def rounded(df: DataFrame) -> DataFrame:
    """Numbers as the SQL twins round them."""

    def digits(name: str) -> int:
        return 9 if name.split("_")[-1] in ("mean", "min", "max") else 6

    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(name, digits(name)) for name in doubles})


# Text


def dirty(text: Column) -> Column:
    """The test data are clean, so dirt is put in, here and in the SQL twin."""
    text = F.replace(F.replace(text, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit("\r\n\r\n\r"))
    return F.concat(F.lit(" # "), text, F.lit("\x00 "))


def marked(text: Column) -> Column:
    text = F.replace(text, F.lit(", "), F.lit(", *em* __strong__ a_b_c [l](u) "))
    text = F.replace(text, F.lit("\n"), F.lit("\n---\n# "))
    tail = "\n```\ncode ` x\n```\n`in` ![](p.png) ![alt](q.png) <i>t</i>\n***\n"
    return F.concat(F.lit("## "), text, F.lit(tail))


def q_clean_text(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", tx.clean_text(dirty(F.col("text"))).alias("text")).withColumn(
        "char_count", F.char_length("text")
    )


def q_markdown_strip(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", tx.strip_markdown(marked(F.col("text"))).alias("text"))


def q_html_strip(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


def q_drop_empty_docs(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    blank = F.when(F.col("quality") == 0, "\n \t\u2003").otherwise(F.col("text"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return (
        docs.join(labels, "doc_id", "left")
        .select("doc_id", blank.alias("text"))
        .filter(tx.has_text(F.col("text")))
        .select("doc_id", F.char_length(tx.clean_text(F.col("text"))).alias("char_count"))
    )


def q_doc_metadata(spark, folder):
    columns = files.document_metadata(path_column(), F.col("text"))
    return table(spark, folder, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


def q_text_sha(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.text_sha(F.col("text")).alias("text_sha"))


def q_page_assembly(spark, folder):
    return files.assemble_pages(table(spark, folder, "conversations"), "conv_id", "turn")


def q_qa_pairs(spark, folder):
    return evalset.question_answer_pairs(table(spark, folder, "conversations"))


# Chunks


def q_chunk_windows(spark, folder):
    return windows(spark, folder).select("doc_id", "pos", "filename", "chunk_text", "char_count")


def q_chunk_index(spark, folder):
    """Numbers need no text: how many windows a document has follows from its length."""
    counts = stage(chunking.window_counts(documents(spark, folder)).filter("n > 0"), spark)
    positions = counts.select("experiment", "doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    return chunking.with_chunk_index(positions, chunking.offsets_of_counts(counts)).select("doc_id", "pos", "chunk_index")


def q_chunk_overlap_check(spark, folder):
    return chunking.overlap_with_next(windows(spark, folder), SETTINGS.chunk_overlap).drop("experiment")


def q_recursive_chunk_invariants(spark, folder):
    """Sizes, origin and order of recursive chunks, and that no word is lost."""
    docs = documents(spark, folder)
    # The chunks of a document are as long as it is and fit a row as it does.
    cut = chunking.chunk_recursive(docs).groupBy("doc_id").agg(
        F.collect_list("chunk_text").alias("chunks"), F.max("pos").alias("last"), F.count_distinct("pos").alias("n")
    )
    words = F.flatten(F.transform("chunks", lambda c: F.array_distinct(F.split(c, r"[\s.]+"))))
    size = SETTINGS.chunk_size
    return docs.join(cut, "doc_id").select(
        "doc_id",
        F.forall("chunks", lambda c: F.char_length(c).between(1, size)).alias("sized"),
        F.forall("chunks", lambda c: F.contains("text", c)).alias("inside"),
        ((F.size("chunks") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("ordered"),
        F.size(F.filter(F.array_distinct(words), lambda w: F.char_length(w).between(1, size - 1))).alias("short_words"),
    )


# Dense search


def unit_table(spark: SparkSession, folder: str, dims: int = 64, experiment: str = "") -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", "label", F.slice("embedding", 1, dims).alias("embedding")
    )
    return vectors.filter(F.col("embedding").isNotNull()).select(
        F.lit(experiment).alias("cell"), "vec_id", "label", normalize(as_double(F.col("embedding"))).alias("vector")
    )


def centers(units: DataFrame) -> DataFrame:
    """Mean vector of every label: queries that come from the whole table."""
    return (
        units.select("cell", "label", F.posexplode("vector").alias("i", "x"))
        .groupBy("cell", "label", "i")
        .agg(F.avg("x").alias("x"))
        .groupBy("cell", "label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select("cell", F.col("label").cast("bigint").alias("qid"), normalize(F.col("v.x")).alias("vector"))
    )


def dense_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    units = unit_table(spark, folder)
    return densesearch.topk_dense(units.drop("label"), centers(units), k)


def q_normalize_vectors(spark, folder):
    scaled = F.transform(as_double(F.col("embedding")), lambda x: x * (F.col("label") + 1))
    return (
        table(spark, folder, "embeddings")
        .select("vec_id", F.posexplode(normalize(scaled)).alias("dim", "value"))
        .withColumn("value", F.round("value", 6))
    )


def q_topk_dense(spark, folder):
    return dense_hits(spark, folder, SETTINGS.k).drop("cell")


def q_topk_cells(spark, folder):
    units = unit_table(spark, folder).drop("label")
    queries = units.select("cell", F.col("vec_id").alias("qid"), "vector")
    found = densesearch.topk_dense(units, queries, SETTINGS.k, backend="cells", exclude_self=True)
    return found.drop("cell")


def q_topk_approximate(spark, folder):
    """Neighbours of every 50th vector among all; approximate, so without a SQL twin."""
    units = unit_table(spark, folder).drop("label")
    queries = units.filter("vec_id % 50 = 0").select("cell", F.col("vec_id").alias("qid"), "vector")
    return densesearch.topk_dense(units, queries, 10, backend="inverted", exclude_self=True).drop("cell")


def q_topk_with_text(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("vec_id"), tx.file_name(path_column()).alias("filename"), "text"
    )
    found = stage(dense_hits(spark, folder, SETTINGS.k), spark)
    return found.join(docs, "vec_id").select("qid", "rank", "vec_id", "sim", "filename", "text")


def q_mmr(spark, folder):
    pool = dense_hits(spark, folder, SETTINGS.fetch_k)
    vectors = unit_table(spark, folder).drop("label")
    return mmr_pick(pool, vectors, ["vec_id"], SETTINGS.k, SETTINGS.lambda_mult).drop("cell")


# Text search and cache


def q_term_table(spark, folder):
    return index(spark, folder).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def q_topk_text(spark, folder):
    return hits(spark, folder).drop("experiment")


def odd_items(spark: SparkSession, folder: str) -> DataFrame:
    """All questions, and each once more with vowels replaced: most of its words are unknown then."""
    asked = items(spark, folder).select("qid", "question")
    strange = asked.select((F.col("qid") + 1_000_000).alias("qid"), F.translate("question", "aeiou", "xqxqx").alias("question"))
    return asked.unionByName(strange)


def q_topk_text_postings(spark, folder):
    settings = SETTINGS.variant({"retriever.backend": "postings"})
    found = load_or_build_index(documents(spark, folder), [(chunking.BASE, settings)], **saved(spark, folder))
    return rag.retrieve(odd_items(spark, folder), found, settings).drop("experiment")


def q_mmr_text(spark, folder):
    return hits(spark, folder, SETTINGS.variant({"retriever.search_type": "mmr"})).drop("experiment")


def q_contexts_by_query(spark, folder):
    asked = items(spark, folder).withColumn("experiment", F.lit(chunking.BASE))
    return answering.contexts_by_query(asked, hits_with_text(spark, folder)).select(
        "qid", answering.context_block(F.col("contexts")).alias("contexts"), F.size("contexts").alias("n_contexts")
    )


def q_source_preview(spark, folder):
    return answering.source_listing(hits_with_text(spark, folder)).drop("experiment")


def letter_counts():
    """A small embedder: how often each of some letters occurs."""

    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([[t.count(c) for c in oracles.LETTERS] for t in texts], np.float32)

    return predict


hooks.register_embedder(MODEL, letter_counts)


def cached_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that have labels, as texts embedded earlier."""
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id"), "doc_id")
    texts = cache.keyed(labelled, MODEL).select("model", "text_sha", "text").dropDuplicates(cache.KEY)
    return hooks.embedder(MODEL)(texts).select("model", "text_sha", "embedding")


def keyed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return cache.keyed(table(spark, folder, "documents").select("doc_id", "text"), MODEL)


def q_cache_hits(spark, folder):
    return cache.cache_hits(keyed_documents(spark, folder), cached_texts(spark, folder)).select("doc_id", "text_sha")


def q_cache_misses(spark, folder):
    return cache.cache_misses(keyed_documents(spark, folder), cached_texts(spark, folder)).select("text_sha", "text")


def q_cache_merge(spark, folder):
    texts = table(spark, folder, "documents").select("doc_id", "text")
    merged, _ = cache.embed_with_cache(texts, cached_texts(spark, folder), hooks.embedder(MODEL), MODEL)
    counts = F.array_join(F.col("embedding").cast("array<bigint>").cast("array<string>"), ",")
    return merged.select("doc_id", "text_sha", counts.alias("embedding"))


# Answers


def q_prompt_table(spark, folder):
    asked = items(spark, folder).withColumn("experiment", F.lit(chunking.BASE))
    gathered = answering.contexts_by_query(asked, hits_with_text(spark, folder))
    return answering.prompts(gathered).select("qid", "system", "human")


def q_extractive_answer(spark, folder):
    return records(spark, folder).select("qid", "answer")


def q_rag_end_to_end(spark, folder):
    built = rag.Rag(SETTINGS).build(documents(spark, folder), **saved(spark, folder))
    return built.batch_query(items(spark, folder)).select(
        "qid",
        "question",
        "answer",
        answering.context_block(F.col("contexts")).alias("contexts"),
        F.size("source_documents").alias("n_sources"),
    )


def q_eval_records(spark, folder):
    shaped = metrics.eval_records(records(spark, folder)).drop("experiment")
    return shaped.withColumn("retrieved_contexts", answering.context_block(F.col("retrieved_contexts")))


def repeat_words(options: hooks.ChatOptions):
    """A small chat: the settings and the first words of the question; some prompts fail once, some always."""
    failed = set()

    def ask(system: str, human: str) -> str:
        question = human.split(answering.BEFORE_QUESTION)[-1].removesuffix(answering.AFTER_QUESTION)
        if len(question) % 7 == 0 or len(question) % 5 == 0 and question not in failed:
            failed.add(question)
            raise OSError("busy")
        words = question.split(" ")[: options.max_tokens]
        return f"{options.model} {options.temperature:.2f} {len(human)}: {' '.join(words)}"

    return ask


hooks.register_chat("repeat_words", repeat_words)


def q_written_answers(spark, folder):
    """Answers of a registered chat, several prompts in flight, with the settings of the run."""
    chat = {"llm.provider": "repeat_words", "llm.model_name": "small", "llm.temperature": 0.25, "llm.max_tokens": 4}
    return rag.answer_all(
        brief_items(spark, folder), hits_with_text(spark, folder, brief_items), [chunking.BASE], SETTINGS.variant(chat)
    ).select("qid", "answer", "error")


# Metrics


def q_claims(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(tx.claims(F.col("text"))).alias("claim_no", "claim"))


def q_claim_verdicts(spark, folder):
    return metrics.claim_verdicts(records(spark, folder)).drop("experiment")


def metric_query(metric: str):
    asked = brief_items if metric in ("answer_relevancy", "context_precision") else items
    return lambda spark, folder: rounded(scored(spark, folder, (metric,), asked)).drop("experiment")


def q_scores_wide(spark, folder):
    scores = all_scores(spark, folder)
    return rounded(metrics.score_wide(scores.select("experiment", "qid").distinct(), scores)).drop("experiment")


def q_metric_aggregates(spark, folder):
    """Scores as a judge may send them: some are missing, NaN or no number."""
    scores = all_scores(spark, folder)
    wide = metrics.score_wide(scores.select("experiment", "qid").distinct(), scores)
    slot = F.col("qid") % 7
    broken = {
        m: F.when(slot == 3, "NaN").when(slot == 5, "n/a").when(slot != 6, F.col(m).cast("string"))
        for m in SETTINGS.metrics
    }
    return rounded(metrics.aggregate_scores(wide.withColumns(broken))).drop("experiment")


def q_score_report(spark, folder):
    return metrics.score_report(metrics.metric_statistics(aggregates(spark, folder, brief_items))).drop("experiment")


def q_score_bands(spark, folder):
    return rounded(metrics.score_bands(metrics.metric_statistics(aggregates(spark, folder)))).drop("experiment")


def q_diagnosis(spark, folder):
    return metrics.diagnosis(aggregates(spark, folder, brief_items)).drop("experiment")


# Sweeps


def size_summary(spark: SparkSession, folder: str) -> DataFrame:
    scores = sweeps.chunk_size_scores(documents(spark, folder), items(spark, folder), SETTINGS, **saved(spark, folder))
    return sweeps.experiment_summary(stage(scores, spark), sweeps.chunk_size_variants())


def k_summary(spark: SparkSession, folder: str) -> DataFrame:
    scores = sweeps.k_scores(documents(spark, folder), items(spark, folder), SETTINGS, **saved(spark, folder))
    return sweeps.experiment_summary(stage(scores, spark), sweeps.k_variants())


def both_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return sweeps.stack_summaries([size_summary(spark, folder), k_summary(spark, folder)])


def q_sweep_settings(spark, folder):
    variants = sweeps.chunk_size_variants()
    settings = sweeps.sweep_settings(spark, SETTINGS, variants).drop("fetch_k", "lambda_mult")
    sizes = [
        (v["experiment"], v["overrides"]["chunking.chunk_size"], v["overrides"]["chunking.chunk_overlap"]) for v in variants
    ]
    counts = chunking.window_counts(documents(spark, folder), sizes).groupBy("experiment")
    return settings.join(counts.agg(F.sum("n").alias("n_chunks")), "experiment")


def q_k_sweep(spark, folder):
    return rounded(metrics.metric_statistics(k_summary(spark, folder)))


def q_chunk_size_sweep(spark, folder):
    return rounded(metrics.metric_statistics(size_summary(spark, folder)))


def q_embedding_sweep(spark, folder):
    """Two embeddings of one corpus; a hit is relevant when it has the label asked for."""
    models = {"embedding_full": 64, "embedding_half": 32}
    units = functools.reduce(DataFrame.unionByName, [unit_table(spark, folder, d, name) for name, d in models.items()])
    found = densesearch.topk_dense(units.drop("label"), centers(units), SETTINGS.k)
    labels = units.select("cell", "vec_id", "label")
    relevant = found.join(labels, ["cell", "vec_id"]).select(
        F.col("cell").alias("experiment"), "qid", "rank", (F.col("label") == F.col("qid")).alias("relevant")
    )
    return rounded(metrics.context_precision(relevant))


def q_benchmark_summary(spark, folder):
    return rounded(both_summaries(spark, folder))


def q_param_series(spark, folder):
    return rounded(sweeps.param_series(both_summaries(spark, folder)))


def q_metric_matrix(spark, folder):
    matrix = sweeps.metric_matrix(both_summaries(spark, folder))
    return matrix.withColumns({m: F.round(m, 9) for m in metrics.METRICS})


def q_stage_counts(spark, folder):
    """All counts of a run from one scan of the documents.

    Sums of a query, not ``observe()``: what a task of a shuffle stage observed counts twice if the task
    runs again after a lost executor.
    """
    base = SETTINGS.chunk_size, SETTINGS.chunk_overlap
    texts = keyed_documents(spark, folder).withColumn(
        "n_chunks", chunking.window_count(tx.clean_text(F.col("text")), *base)
    )
    by_key = texts.groupBy(*cache.KEY).agg(F.count("*").alias("n"), F.sum("n_chunks").alias("n_chunks"))
    known = cached_texts(spark, folder).select(*cache.KEY, F.lit(True).alias("known"))
    counts = {
        "documents": F.sum("n"),
        "chunks": F.sum("n_chunks"),
        "cache_hits": F.sum(F.when(F.col("known"), F.col("n"))),
        "cache_misses": F.count_if(F.col("known").isNull()),
    }
    totals = by_key.join(known, cache.KEY, "left").agg(
        *[F.coalesce(total, F.lit(0)).cast("bigint").alias(name) for name, total in counts.items()]
    )
    return totals.unpivot([], list(counts), "stage", "n")


def entry(spark: SparkSession) -> DataFrame:
    """All questions answered from the smallest corpus and scored, one row per question."""
    return shipped(q_scores_wide)(spark, SMALLEST)


def shipped(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose tasks find this code, wherever the session was started."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark, os.path.abspath(__file__), os.path.abspath(oracles.__file__))
        return query(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name[2:]: query for name, query in globals().items() if name.startswith("q_")}
    found.update({metric: metric_query(metric) for metric in SETTINGS.metrics})
    if llm:
        found.update(llm.QUERIES, pipeline=corpus_pipeline.run)
    return {name: shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.sql() | (llm.SQL if llm else {})
