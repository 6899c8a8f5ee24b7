import json
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark import hooks
from evalspark.operators import answering, metrics
from evalspark.plans import sweeps
from evalspark.plans.rag import Rag
from evalspark.settings import Settings, sweep_overlap
from evalspark.sources import evalset, files, tables
from evalspark.streaming.incremental import embed_stream

SMALL = Settings(chunk_size=60, chunk_overlap=10, k=2, fetch_k=4)


def vowels():
    return lambda texts: np.array([[t.lower().count(c) for c in "aeiou"] for t in texts], np.float32)


hooks.register_embedder("vowels", vowels)
hooks.register_writer("echo", lambda system, human: human.str.slice(0, 8) + "  ")


def test_settings():
    with pytest.raises(ValueError, match="Unknown search_type: 'invalid_type'"):
        Settings(search_type="invalid_type")
    with pytest.raises(ValueError):
        Settings(k=0)
    with pytest.raises(ValueError):
        Settings(chunk_size=10, chunk_overlap=11)
    with pytest.raises(KeyError):
        Settings().variant({"retriever.unknown": 1})
    assert Settings().variant({"retriever.k": 7}).k == 7
    assert [sweep_overlap(s) for s in (128, 256, 512, 1024)] == [32, 32, 64, 128]


def test_query_before_build():
    with pytest.raises(RuntimeError, match="build"):
        Rag().query("anything")


def test_answers(corpus, questions, tmp_path):
    rag = Rag(SMALL).build(corpus, str(tmp_path))
    rows = {r.qid: r for r in rag.batch_query(questions).collect()}
    assert rows[0].answer == "Cats purr when they are happy" and rows[0].source_documents[0].filename == "file0.txt"
    # Nothing is known of this question: it has k contexts all the same, and none answers it.
    assert rows[2].answer == answering.REFUSAL and len(rows[2].contexts) == SMALL.k
    assert [d.sim for d in rows[2].source_documents] == [0.0] * SMALL.k
    assert all(len(r.contexts) <= 2 for r in rows.values())
    for document in (d for r in rows.values() for d in r.source_documents):
        before = rag.index.chunks.filter(f"doc_id < {document.doc_id}").count()
        assert document.chunk_index == before + document.pos
    one = rag.query("Why do cats purr?").collect()
    assert len(one) == 1 and one[0].answer == rows[0].answer


def test_index_is_loaded_only_for_same_corpus_and_settings(spark, corpus, tmp_path, monkeypatch):
    root = str(tmp_path)
    built = []
    real = tables.build_index
    monkeypatch.setattr(tables, "build_index", lambda *a: built.append(a) or real(*a))
    runs = [("base", SMALL)]
    tables.load_or_build_index(corpus, runs, root)
    tables.load_or_build_index(corpus, runs, root)
    assert len(built) == 1
    tables.load_or_build_index(corpus, [("base", SMALL.variant({"chunking.chunk_size": 70}))], root)
    changed = corpus.withColumn("text", F.concat("text", F.when(F.col("doc_id") == 3, "!").otherwise("")))
    tables.load_or_build_index(changed, runs, root)
    assert len(built) == 3
    tables.load_or_build_index(corpus, runs, root, rebuild=True)
    assert len(built) == 4
    assert tables.load_index(spark, root, "no such mark", ["base"]) is None


def test_evaluate(corpus, questions, tmp_path):
    _, wide, aggregates = Rag(SMALL).build(corpus, str(tmp_path)).evaluate(questions)
    scores = {r.qid: r for r in wide.collect()}
    assert scores[0].faithfulness == 1.0 and scores[0].context_recall == 1.0 and scores[0].context_precision == 1.0
    assert scores[2].faithfulness == 0.0
    row = aggregates.head()
    assert row.faithfulness_mean == pytest.approx(sum(r.faithfulness for r in scores.values()) / 3)


def test_mmr_and_hooks(corpus, questions, tmp_path):
    varied = SMALL.variant({"retriever.search_type": "mmr", "embedding.provider": "vowels", "embedding.model_name": "v"})
    varied = varied.variant({"llm.provider": "echo"})
    rag = Rag(varied).build(corpus, str(tmp_path))
    rows = rag.batch_query(questions).collect()
    assert all(r.answer == "Context:" and len(r.contexts) == 2 for r in rows)
    stored = tables.load_cache(corpus.sparkSession, f"{tmp_path}/cache").count()
    # The same texts under another index come from the cache.
    Rag(varied).build(corpus.filter("doc_id < 3"), str(tmp_path))
    assert tables.load_cache(corpus.sparkSession, f"{tmp_path}/cache").count() == stored
    _, wide, _ = rag.evaluate(questions)
    assert all(r.answer_relevancy is not None for r in wide.collect())
    with pytest.raises(ValueError, match="Unknown LLM provider"):
        Rag(SMALL.variant({"llm.provider": "nobody"})).build(corpus, str(tmp_path)).batch_query(questions)


def test_sweeps(spark, corpus, questions, tmp_path):
    root = str(tmp_path)
    by_k = sweeps.k_scores(corpus, questions, SMALL, (1, 3), root)
    for k in (1, 3):
        alone = Rag(SMALL.variant({"retriever.k": k})).build(corpus, root).evaluate(questions)[1]
        want = {r.qid: [r[m] for m in metrics.METRICS] for r in alone.collect()}
        mine = metrics.score_wide(questions.withColumn("experiment", F.lit(f"retrieval_k_{k}")), by_k)
        assert {r.qid: pytest.approx([r[m] for m in metrics.METRICS]) for r in mine.collect()} == want
    by_size = sweeps.chunk_size_scores(corpus, questions, SMALL, (64, 128), root)
    models = [{"name": "a", "provider": "tfidf", "model_name": "tfidf"}, {"name": "b", "provider": "vowels", "model_name": "v"}]
    by_model = sweeps.embedding_scores(corpus, questions, SMALL, models, root)
    summary = sweeps.stack_summaries(
        [
            sweeps.experiment_summary(by_k, sweeps.k_variants((1, 3))),
            sweeps.experiment_summary(by_size, sweeps.chunk_size_variants((64, 128))),
            sweeps.experiment_summary(by_model, sweeps.embedding_variants(models)).drop("context_recall_mean"),
        ]
    ).cache()
    rows = {r.experiment: r for r in summary.collect()}
    assert set(rows) == {"retrieval_k_1", "retrieval_k_3", "chunk_size_64", "chunk_size_128", "embedding_a", "embedding_b"}
    assert rows["chunk_size_64"].param_value == "64" and rows["embedding_b"].param_value == "v"
    assert rows["embedding_a"].context_recall_mean is None
    series = {(r.experiment, r.metric): r.mean for r in sweeps.param_series(summary).collect()}
    assert series[("embedding_a", "context_recall")] == 0.0
    matrix = {r.experiment: r.context_recall for r in sweeps.metric_matrix(summary).collect()}
    assert matrix["embedding_a"] is None
    path = tables.save_summary(summary, root)
    assert spark.read.option("header", True).csv(path).count() == 6
    assert tables.save_summary(summary.limit(0), root) is None
    settings = sweeps.sweep_settings(spark, SMALL, sweeps.chunk_size_variants((128,))).head()
    assert (settings.chunk_size, settings.chunk_overlap, settings.k) == (128, 32, 2)


def test_scores_to_csv(spark, tmp_path):
    frame = spark.createDataFrame([("e", 0, ["a", "b"], 0.5)], "experiment string, qid bigint, contexts array<string>, faithfulness double")
    path = tables.save_scores(frame, str(tmp_path), "run")
    row = spark.read.option("header", True).option("escape", "\\").csv(path).head()
    assert json.loads(row.contexts) == ["a", "b"] and row.experiment == "e" and "/ragas_run_" in path


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").write_bytes(b"plain\xff text\r\n\r\n\r\n\r\nend")
    (tmp_path / "a.MD").write_text("# Title\n**bold** [t](u)")
    (tmp_path / "sub" / "c.markdown").write_text("`x` rest")
    (tmp_path / "empty.txt").write_text(" \n ")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.csv").write_text("1,2")
    docs, rejects = files.load_files(spark, str(tmp_path))
    rows = docs.orderBy("doc_id").collect()
    assert [(r.doc_id, r.filename, r.file_type, r.text) for r in rows] == [
        (0, "a.MD", "md", "Title\nbold t"),
        (1, "b.txt", "txt", "plain� text\n\nend"),
        (2, "c.markdown", "markdown", "rest"),
    ]
    assert all(r.char_count == len(r.text) and r.source.endswith(r.filename) for r in rows)
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in rejects.collect()} == {
        "empty.txt": "empty",
        "d.pdf": "no loader",
        "e.csv": "unsupported",
    }
    with pytest.raises(FileNotFoundError):
        files.load_files(spark, str(tmp_path / "missing"))
    (tmp_path / "none").mkdir()
    docs, rejects = files.load_files(spark, str(tmp_path / "none"))
    assert docs.count() == 0 and rejects.count() == 0


def test_pages(spark):
    rows = [(1, 2, "b"), (1, 0, "a"), (1, 1, ""), (2, 0, None), (3, 10, "z"), (3, 9, "y")]
    pages = spark.createDataFrame(rows, "doc int, page int, text string")
    got = {r.doc: (r.text, r.n_pages) for r in files.assemble_pages(pages, "doc", "page").collect()}
    assert got == {1: ("a\n\nb", 2), 3: ("y\n\nz", 2)}


def test_eval_set(spark, tmp_path):
    def load(items):
        path = tmp_path / "eval.json"
        path.write_text(json.dumps(items, indent=1))
        return evalset.load_eval_dataset(spark, str(path))

    rows = load([{"question": "q1", "ground_truth": "g1"}, {"question": "q2", "ground_truth": "g2", "category": "c"}]).collect()
    assert [(r.qid, r.question, r.ground_truth, r.extra) for r in rows] == [(0, "q1", "g1", {}), (1, "q2", "g2", {"category": "c"})]
    assert load([]).count() == 0
    with pytest.raises(ValueError, match=r"Item 1 .*ground_truth"):
        load([{"question": "q", "ground_truth": "g"}, {"question": "q"}])
    with pytest.raises(FileNotFoundError):
        evalset.load_eval_dataset(spark, str(tmp_path / "missing.json"))


def test_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (2, 0, "user", "x"), (2, 1, "user", "y")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in evalset.question_answer_pairs(turns).collect()] == [(1, 0, "q", "a")]


def test_stream(spark, corpus, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "cache", "checkpoint"))

    def run():
        stream = spark.readStream.schema(corpus.schema).parquet(source)
        embed_stream(stream, hooks.embedder("vowels", "chunk_text"), "v", store, checkpoint, SMALL).awaitTermination()
        return tables.load_cache(spark, store).count()

    corpus.filter("doc_id < 2").write.mode("append").parquet(source)
    first = run()
    corpus.filter("doc_id < 3").write.mode("append").parquet(source)
    second = run()
    assert first > 0 and second > first
    keys = tables.load_cache(spark, store).select("model", "text_sha")
    assert keys.distinct().count() == second
    assert run() == second


# Chats


def options_of(options):
    return lambda system, human: f"{options.model} {options.temperature} {options.max_tokens}"


hooks.register_chat("told", options_of)
hooks.register_writer("told_batch", lambda system, human, options: human.str.slice(0, 3) + options.model)


def test_settings_reach_the_model(corpus, questions, tmp_path):
    asked = {"llm.model_name": "big", "llm.temperature": 0.5, "llm.max_tokens": 7}
    for provider, answer in (("told", "big 0.5 7"), ("told_batch", "Conbig")):
        rag = Rag(SMALL.variant({"llm.provider": provider, **asked})).build(corpus, str(tmp_path))
        assert {r.answer for r in rag.batch_query(questions).collect()} == {answer}


def numbered(n):
    return [(str(i), f"prompt {i}") for i in range(n)]


def test_calls_are_bounded_repeated_and_in_order():
    running, most, tries = [0], [0], {}
    lock = threading.Lock()

    def ask(system, human):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            tries[system] = tries.get(system, 0) + 1
        try:
            time.sleep(0.002 * (int(system) % 5))
            if int(system) % 3 == 0 and tries[system] < 2 or int(system) % 10 == 9:
                raise OSError("busy")
            return human.upper()
        finally:
            with lock:
                running[0] -= 1

    options = hooks.ChatOptions(in_flight=4, attempts=3)
    frame = pd.DataFrame(numbered(100), columns=["system", "human"])
    out = pd.concat(answers_of(lambda _: ask, options, [frame[:60], frame[60:], frame[:0]]))
    assert len(out) == 100 and 1 < most[0] <= 4
    for i, (answer, error) in enumerate(zip(out["answer"], out["error"])):
        assert (answer, error) == ((None, "OSError: busy") if i % 10 == 9 else (f"PROMPT {i}", None))
    assert all(tries[str(i)] == (3 if i % 10 == 9 else 2 if i % 3 == 0 else 1) for i in range(100))


def test_a_hanging_call_is_a_timeout_row():
    def ask(system, human):
        time.sleep(30 if int(system) in (3, 4) else 0)
        return "ok"

    options = hooks.ChatOptions(in_flight=2, timeout=0.3, attempts=1)
    start = time.time()
    (out,) = answers_of(lambda _: ask, options, [pd.DataFrame(numbered(12), columns=["system", "human"])])
    assert time.time() - start < 10
    assert [i for i, e in enumerate(out["error"]) if e == "timeout"] == [3, 4]
    assert list(out["answer"]).count("ok") == 10


def answers_of(make_ask, options, frames):
    """The task's side of a chat, without Spark."""

    class Prompts:
        schema = T.StructType([])

        @staticmethod
        def mapInPandas(answer, _):
            return list(answer(iter(frames)))

    return hooks.chat_writer(make_ask, options)(Prompts)


def logged_letters(model):
    """Vectors of letters; each embedded text is noted in the file that the model names."""

    def predict(texts):
        with open(model, "a") as file:
            file.writelines(json.dumps(t) + "\n" for t in texts)
        return np.array([[t.lower().count(c) for c in "aeiou"] for t in texts], np.float32)

    return predict


hooks.register_embedder("logged", logged_letters)
hooks.register_judge("never", lambda claim, context: pd.Series([False] * len(claim)))


def test_questions_and_claims_go_through_the_cache(corpus, questions, tmp_path):
    log = tmp_path / "embedded"
    model = {"embedding.provider": "logged", "embedding.model_name": str(log)}
    rag = Rag(SMALL.variant(model)).build(corpus, str(tmp_path / "index"))
    first = {r.qid: r.answer_relevancy for r in rag.evaluate(questions)[1].collect()}
    texts = [json.loads(line) for line in log.read_text().splitlines()]
    assert len(texts) == len(set(texts)) and {r.question for r in questions.collect()} <= set(texts)
    again = Rag(rag.settings).build(corpus, str(tmp_path / "index"))
    assert {r.qid: r.answer_relevancy for r in again.evaluate(questions)[1].collect()} == first
    assert len(log.read_text().splitlines()) == len(texts)
    more = sweeps.k_scores(corpus, questions, rag.settings, (1, 2), str(tmp_path / "index"))
    assert more.count() == 2 * 4 * questions.count()


def test_judge_in_sweeps(corpus, questions, tmp_path):
    scores = sweeps.k_scores(corpus, questions, SMALL, (1, 2), str(tmp_path), judge="never")
    got = {(r.metric, r.score) for r in scores.filter("metric IN ('faithfulness', 'context_recall', 'context_precision')").collect()}
    assert {s for _, s in got} == {0.0}
    by_size = sweeps.chunk_size_scores(corpus, questions, SMALL, (40, 60), str(tmp_path), judge="never")
    assert {r.score for r in by_size.filter("metric = 'context_recall'").collect()} == {0.0}
