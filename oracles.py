"""Plain SQL twins of the queries, for a check by another engine (DuckDB dialect)."""

from __future__ import annotations

from evalspark.operators import answering

# Fixed values, written out here so that a wrong one in the library shows.
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
THRESHOLDS = {"faithfulness": 0.8, "answer_relevancy": 0.75, "context_precision": 0.7, "context_recall": 0.8}
SIZES = (("chunk_size_256", 256, 32), ("chunk_size_512", 512, 64), ("chunk_size_1024", 1024, 128))
K_VALUES = (2, 4, 6, 8)
ADVICE = {
    "faithfulness": "Answers say things that their contexts do not: look at the prompt and the writer first",
    "answer_relevancy": "Answers drift from the question: ask for shorter ones and pass on fewer contexts",
    "context_precision": "Contexts without use rank high: try other vectors, shorter chunks or more diversity",
    "context_recall": "The contexts lack needed facts: retrieve more or longer chunks, or add documents",
}
# Metric and whether it is low.
PATTERNS = (
    (("faithfulness", True), ("context_precision", False), "Good contexts are found and not used"),
    (("faithfulness", False), ("context_recall", True), "Answers keep to contexts that hold too little"),
    (("context_precision", True), ("context_recall", True), "The search finds neither enough nor the right chunks"),
)
# White space and the patterns of the text rules below.
WS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
# A question is the whole text of an item; some queries ask by its first words only.
ASKED = "array_to_string(string_split(text, ' ')[1:16], ' ')"
STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def lit(text: str) -> str:
    """A string literal; line ends become chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def clean(x: str) -> str:
    x = f"replace({x}, chr(0), '')"
    for pattern, new in ((r"\r\n?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", "' '")):
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return strip(x)


def markdown(x: str) -> str:
    for pattern, new in (
        (rf"(?m)^#{{1,6}}[{WS}]+", ""),
        (r"\*{1,2}([^*\n]+)\*{1,2}", r"\1"),
        (r"_{1,2}([^_\n]+)_{1,2}", r"\1"),
        (r"```[\s\S]*?```", ""),
        (r"`[^`\n]+`", ""),
        (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
        (r"!\[([^\]]*)\]\([^)]+\)", r"\1"),
        (r"<[^>]+>", ""),
        (rf"(?m)^[-*_]{{3,}}[{WS}]*$", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[\s.,;:!?]+'), lambda t: t <> '')"


def claims(x: str) -> str:
    split = rf"regexp_split_to_array({x}, '[.!?]+\s+|\n+')"
    return f"list_filter(list_transform({split}, lambda s: {strip('s')}), lambda s: s <> '')"


def share(part: str, whole: str) -> str:
    part = f"list_distinct({part})"
    return f"(len(list_intersect({part}, list_distinct({whole}))) / nullif(len({part}), 0))"


DIRTY = (
    "(chr(160) || '# ' || replace(replace(text, ' ', '  '), chr(10), "
    "chr(13) || chr(10) || chr(13) || chr(10) || chr(13)) || chr(0) || chr(8195))"
)
MARKED = (
    "('## ' || replace(replace(text, ', ', ', *em* __strong__ a_b_c [l](u) '), chr(10), chr(10) || '---' || chr(10) || '# ') "
    "|| chr(10) || '```' || chr(10) || 'code ` x' || chr(10) || '```' || chr(10) || '`in` ![](p.png) ![alt](q.png) <i>t</i>' "
    "|| chr(10) || '***' || chr(10))"
)
PATH = "('/' || source || '/' || coalesce(lang, 'xx') || '/Doc.' || doc_id || '.TXT')"
FILENAME = "('Doc.' || doc_id || '.TXT')"
BASE = (("base", 512, 64),)
DOCS = f"docs as materialized (select doc_id, {clean('text')} as text, {FILENAME} as filename from documents)"


def chunks(runs=BASE) -> str:
    cuts = " union all ".join(
        f"select '{name}' as experiment, doc_id, (s // {size - over})::int as pos, filename, "
        f"substring(text, s + 1, {size}) as chunk_text "
        f"from (select *, unnest(range(0, greatest(length(text) - {over}, 1), {size - over})) as s "
        "from docs where text <> '')"
        for name, size, over in runs
    )
    return f"{DOCS}, chunks as materialized ({cuts})"


def terms(runs=BASE) -> str:
    return (
        f"{chunks(runs)}, words as (select experiment, doc_id, pos, unnest({tokens('chunk_text')}) as term from chunks), "
        "tf as materialized (select experiment, doc_id, pos, term, count(*) as tf from words group by all), "
        "n as (select experiment, count(*) as n_chunks from chunks group by all), "
        "terms as materialized (select experiment, term, count(*) as df, "
        "ln((1 + n_chunks) / (1 + count(*))) + 1 as idf from tf join n using (experiment) group by experiment, term, n_chunks)"
    )


def unit(name: str, source: str, keys: str) -> str:
    """Unit TF-IDF weights of the words of ``source(keys, text)``, under every experiment."""
    using = "(experiment, term)" if "experiment" in keys else "(term)"
    every = keys if "experiment" in keys else f"experiment, {keys}"
    return (
        f"{name}_tf as (select {keys}, term, count(*) as tf from (select {keys}, unnest({tokens('text')}) as term "
        f"from {source}) group by all), "
        f"{name}_raw as (select {every}, term, tf * idf as w from {name}_tf join terms using {using}), "
        f"{name} as materialized (select {every}, term, w / sqrt(sum(w * w) over (partition by {every})) as w from {name}_raw)"
    )


def search(runs=BASE, k: int = 4, asked: str = "text") -> str:
    return (
        f"{terms(runs)}, raw as (select experiment, doc_id, pos, term, tf * idf as w from tf join terms using (experiment, term)), "
        "norms as (select experiment, doc_id, pos, sqrt(sum(w * w)) as norm from raw group by all), "
        f"items as (select item_id as qid, {asked} as question, text as ground_truth from benchmark), "
        + unit("asked", "(select qid, question as text from items)", "qid")
        + ", scored as (select experiment, qid, doc_id, pos, round(sum(asked.w * raw.w / norm), 6) as sim "
        "from raw join asked using (experiment, term) join norms using (experiment, doc_id, pos) group by all), "
        "hits as materialized (select experiment, qid, rank::int as rank, doc_id, pos, sim, chunk_text, filename from (select *, row_number() "
        f"over (partition by experiment, qid order by sim desc, doc_id, pos) as rank from scored) "
        f"join chunks using (experiment, doc_id, pos) where rank <= {k})"
    )


def search_all(k: int = 4) -> str:
    """Every chunk has a score, 0 where no word is shared; questions also with vowels replaced."""
    found = search().split(", hits as materialized")[0].replace(
        "from benchmark)",
        "from benchmark union all select item_id + 1000000, translate(text, 'aeiou', 'xqxqx'), text from benchmark)", 1
    )
    return (
        f"{found}, every as (select qid, doc_id, pos, coalesce(sim, 0) as sim from items cross join chunks "
        "left join scored using (qid, doc_id, pos)) select qid, rank::int as rank, doc_id, pos, sim from (select *, row_number() "
        f"over (partition by qid order by sim desc, doc_id, pos) as rank from every) where rank <= {k}"
    )


def records(runs=BASE, ks=(4,), asked: str = "text") -> str:
    """Records per experiment; several k give one experiment each."""
    if len(ks) > 1:
        named = " union all ".join(f"select 'retrieval_k_{k}' as name, {k} as k" for k in ks)
        hits = (
            "picked as (select * exclude (experiment, name, k), name as experiment from hits "
            f"join ({named}) on rank <= k)"
        )
    else:
        hits = "picked as (select * from hits)"
    return (
        f"{search(runs, max(ks), asked)}, {hits}, "
        "gathered as (select experiment, qid, list(chunk_text order by rank) as contexts from picked group by all), "
        "asked_all as (select experiment, qid, question, ground_truth, coalesce(contexts, []) as contexts "
        "from (select distinct experiment from picked) cross join items left join gathered using (experiment, qid)), "
        "sentences as (select experiment, qid, rank, question, unnest(list_zip(s, range(len(s)))) as z from "
        f"(select experiment, qid, rank, question, {claims('chunk_text')} as s from picked join items using (qid))), "
        f"shares as (select experiment, qid, rank, z[1] as sentence, z[2] as no, {share(tokens('question'), tokens('z[1]'))} as share from sentences), "
        "best as (select * from (select *, row_number() over (partition by experiment, qid order by share desc, rank, no) as r "
        "from shares where share >= 0.1) where r = 1), "
        f"records as materialized (select a.*, coalesce({strip('sentence')}, {lit(answering.REFUSAL)}) as answer "
        "from asked_all a left join best using (experiment, qid))"
    )


def scores(runs=BASE, ks=(4,), asked: str = "text") -> str:
    words = tokens("array_to_string(contexts, ' . ')")
    sides = " union all ".join(
        f"select experiment, qid, contexts, '{side}' as side, {claims(side)} as c from records"
        for side in ("answer", "ground_truth")
    )
    if len(ks) > 1:
        # All k share one index, whose words carry the experiment name of that index.
        relevancy_terms = (
            "one as (select term, idf from terms), names as (select distinct experiment from records), "
        )
        own = " cross join names"
        table = "one"
    else:
        relevancy_terms, own, table = "", "", "terms"
    join = "using (experiment, term)" if table == "terms" else "using (term)"

    def weights(name: str, source: str, keys: str) -> str:
        return (
            f"{name}_tf as (select {keys}, term, count(*) as tf from (select {keys}, unnest({tokens('text')}) as term from {source}) group by all), "
            f"{name} as (select {keys}, term, w / sqrt(sum(w * w) over (partition by {keys})) as w from "
            f"(select {keys}, term, tf * idf as w from {name}_tf join {table} {join}))"
        )

    del own
    return (
        f"{records(runs, ks, asked)}, sides as ({sides}), "
        "claim_rows as (select experiment, qid, side, contexts, unnest(list_zip(c, range(len(c)))) as z from sides), "
        f"verdicts as materialized (select experiment, qid, side, z[2]::int as claim_no, z[1] as claim, "
        f"coalesce({share(tokens('z[1]'), words)} >= 0.8, false) as supported from claim_rows), "
        "judged as (select experiment, qid, rank, ground_truth, context, unnest(c) as claim from (select experiment, qid, ground_truth, "
        f"unnest(range(1, len(contexts) + 1)) as rank, unnest(contexts) as context, {claims('ground_truth')} as c from records)), "
        f"relevant as (select experiment, qid, rank, max(coalesce({share(tokens('claim'), tokens('context'))} >= 0.8, false)) as relevant from judged group by all), "
        "running as (select *, sum(relevant::int) over (partition by experiment, qid order by rank) / rank as prec from relevant), "
        f"{relevancy_terms}"
        + weights("question_w", "(select experiment, qid, question as text from records)", "experiment, qid")
        + ", "
        + weights("candidate_w", "(select experiment, qid, claim_no, claim as text from verdicts where side = 'answer')", "experiment, qid, claim_no")
        + ", cosines as (select experiment, qid, sum(c.w * q.w) as total from candidate_w c join question_w q using (experiment, qid, term) group by all), "
        "candidates as (select experiment, qid, count(*) as n from verdicts where side = 'answer' group by all), "
        "scores as materialized (select experiment, qid, metric, score from ("
        "select experiment, qid, 'faithfulness' as metric, avg(supported::int) as score from verdicts where side = 'answer' group by all union all "
        "select experiment, qid, 'answer_relevancy', coalesce(total, 0) / n from candidates left join cosines using (experiment, qid) union all "
        "select experiment, qid, 'context_precision', coalesce(avg(prec) filter (where relevant), 0) from running group by all union all "
        "select experiment, qid, 'context_recall', avg(supported::int) from verdicts where side = 'ground_truth' group by all))"
    )


def only(metric: str, asked: str = "text") -> str:
    return f"with {scores(asked=asked)} select qid, metric, round(score, 6) as score from scores where metric = '{metric}'"


WIDE = ", ".join(f"round(max(score) filter (where metric = '{m}'), 6) as {m}" for m in METRICS)
# Means have exact decimal ends, so they are rounded beyond those.
DIGITS = {"mean": 9, "std": 6, "min": 9, "max": 9}
ROUNDED = ", ".join(f"round({f}(score), {DIGITS[s]}) as {s}" for s, f in STATS.items())
BROKEN = "case when qid % 7 = 3 then 'NaN' when qid % 7 = 5 then 'n/a' when qid % 7 = 6 then null else score::varchar end"
VALUE = "nullif(try_cast(score as double), 'NaN'::double)"
AGGREGATES = ", ".join(
    f"round({f}({VALUE}) filter (where metric = '{m}'), {DIGITS[s]}) as {m}_{s}" for m in METRICS for s, f in STATS.items()
)
WIDE_STATS = ", ".join(
    f"round({f}(score) filter (where metric = '{m}'), {DIGITS[s]}) as {m}_{s}" for m in METRICS for s, f in STATS.items()
)


def both_sweeps(select: str) -> str:
    """Scores of the size sweep and of the k sweep, then ``select`` over ``all_scores``."""
    return (
        f"with a as (with {scores(SIZES)} select experiment, qid, metric, score from scores), "
        f"b as (with {scores(ks=K_VALUES)} select experiment, qid, metric, score from scores), "
        "all_scores as (select *, case when experiment like 'chunk%' then 'chunk_size' else 'retrieval_k' end as param_name, "
        r"regexp_extract(experiment, '\d+$') as param_value from (from a union all from b)), "
        f"stats as (select experiment, param_name, param_value, metric, {ROUNDED} from all_scores group by all) {select}"
    )


def stats_rows(source: str) -> str:
    return f"with {source}, stats as (select experiment, metric, {ROUNDED} from scores group by all) "


UNIT = (
    "unit as materialized (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as v "
    "from (select vec_id, label, embedding::double[] as e from embeddings)), "
)
CENTROIDS = (
    "centers as (select label, list(m order by i) as c from (select label, i, avg(x) as m from "
    "(select label, unnest(v) as x, generate_subscripts(v, 1) as i from unit) group by label, i) group by label), "
    "queries as (select label::bigint as qid, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) as q from centers), "
)


def dense(k: int) -> str:
    return (
        UNIT
        + CENTROIDS
        + "sims as (select qid, vec_id, round(list_dot_product(q, v), 6) as sim from queries cross join unit), "
        "hits as materialized (select qid, rank::int as rank, vec_id, sim from (select *, row_number() over "
        f"(partition by qid order by sim desc, vec_id) as rank from sims) where rank <= {k})"
    )


def mmr(pool: str, ids: str, k: int = 4) -> str:
    """Greedy picks, one step per CTE, over ``pool(qid, rank, ids, sim)`` and ``between(qid, a, b, s)`` by rank."""
    steps = [f"p1 as (select qid, 1 as step, rank from {pool} where rank = 1)"]
    for step in range(2, k + 1):
        steps.append(
            f"p{step} as (select * from p{step - 1} union all select qid, {step}, rank from (select h.qid, h.rank, row_number() over "
            f"(partition by h.qid order by 0.5 * h.sim - 0.5 * max(s) desc, h.rank) as r from {pool} h join between b on b.qid = h.qid and b.a = h.rank "
            f"join p{step - 1} p on p.qid = h.qid and p.rank = b.b where not exists (select 1 from p{step - 1} x where x.qid = h.qid and x.rank = h.rank) "
            "group by h.qid, h.rank, h.sim) where r = 1)"
        )
    return ", ".join(steps) + f" select qid, step as rank, {ids}, sim from p{k} p join {pool} using (qid, rank)"


LETTERS = "eaionrst"
LETTER_VECTOR = "[" + ", ".join(
    f"((length(text) - length(replace(text, '{c}', '')))::float)" for c in LETTERS
) + "]"
CACHED = f"cached as (select distinct sha256(text) as text_sha, {LETTER_VECTOR} as embedding from documents join labels using (doc_id))"


def sql() -> dict[str, str]:
    s = {
        "clean_text": f"select doc_id, {clean(DIRTY)} as text, length({clean(DIRTY)}) as char_count from documents",
        "markdown_strip": f"select doc_id, {markdown(MARKED)} as text from documents",
        "html_strip": "select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as text from pages",
        "drop_empty_docs": (
            "select doc_id, length(t) as char_count from (select doc_id, "
            + clean("case when quality = 0 then chr(10) || ' ' || chr(9) || chr(8195) else text end")
            + " as t from documents left join labels using (doc_id)) where t <> ''"
        ),
        "doc_metadata": (
            f"select doc_id, {PATH} as source, {FILENAME} as filename, 'txt' as file_type, length(text) as char_count from documents"
        ),
        "text_sha": "select doc_id, sha256(text) as text_sha from documents",
        "page_assembly": (
            "select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as text, count(*)::int as n_pages "
            "from conversations where coalesce(text, '') <> '' group by conv_id"
        ),
        "qa_pairs": (
            "select conv_id, turn, question, ground_truth from (select conv_id, turn, role, text as question, "
            "lead(text) over w as ground_truth, lead(role) over w as next_role, lead(turn) over w as next_turn from conversations "
            "window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant' and next_turn = turn + 1"
        ),
        "chunk_windows": f"with {chunks()} select doc_id, pos, filename, chunk_text, length(chunk_text) as char_count from chunks",
        "chunk_index": f"with {chunks()} select doc_id, pos, row_number() over (order by doc_id, pos) - 1 as chunk_index from chunks",
        "chunk_overlap_check": (
            f"with {chunks()}, n as (select doc_id, pos, chunk_text as c, lead(chunk_text) over (partition by doc_id order by pos) as d from chunks) "
            "select doc_id, pos, list_max(list_filter(range(0, 65), lambda n: right(c, n) = left(d, n)))::int as shared_chars "
            "from n where d is not null"
        ),
        "recursive_chunk_invariants": (
            f"with {DOCS}, w as (select doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[\\s.]+'), lambda t: t <> ''))) as t from docs) "
            "select doc_id, true as sized, true as inside, true as ordered, count(*) filter (where length(t) < 512) as short_words "
            "from docs left join w using (doc_id) where text <> '' group by doc_id"
        ),
        "term_table": f"with {terms()} select term, df, round(idf, 6) as idf from terms",
        "normalize_vectors": (
            "select vec_id, i - 1 as dim, round(v[i] / sqrt(list_dot_product(v, v)), 6) as value from "
            "(select vec_id, list_transform(embedding::double[], lambda x: x * (label + 1)) as v from embeddings), range(1, 65) r(i)"
        ),
        "topk_dense": f"with {dense(4)} select qid, rank, vec_id, sim from hits",
        "topk_cells": (
            f"with {UNIT} sims as (select a.vec_id as qid, b.vec_id, round(list_dot_product(a.v, b.v), 6) as sim from unit a "
            "join unit b on a.vec_id <> b.vec_id) select qid, rank::int as rank, vec_id, sim from (select *, row_number() over "
            "(partition by qid order by sim desc, vec_id) as rank from sims) where rank <= 4"
        ),
        "topk_with_text": (
            f"with {dense(4)} select qid, rank, vec_id, sim, {FILENAME} as filename, text from hits join documents on doc_id = vec_id"
        ),
        "mmr": (
            f"with {dense(20)}, between as (select x.qid, x.rank as a, y.rank as b, round(list_dot_product(u.v, w.v), 6) as s "
            "from hits x join hits y using (qid) join unit u on u.vec_id = x.vec_id join unit w on w.vec_id = y.vec_id), "
            + mmr("hits", "vec_id")
        ),
        "mmr_text": (
            f"with {search(k=20)}, pw as (select qid, rank, term, w / norm as w from hits join raw using (experiment, doc_id, pos) "
            "join norms using (experiment, doc_id, pos)), between as (select x.qid, x.rank as a, y.rank as b, "
            "round(coalesce(s, 0), 6) as s from hits x join hits y using (qid) left join (select p.qid, p.rank as ra, q.rank as rb, "
            "sum(p.w * q.w) as s from pw p join pw q using (qid, term) group by all) d on d.qid = x.qid and ra = x.rank and rb = y.rank), "
            + mmr("hits", "doc_id, pos")
        ),
        "topk_text_postings": f"with {search_all()}",
        "topk_text": f"with {search()} select qid, rank, doc_id, pos, sim from hits",
        "contexts_by_query": (
            f"with {search()} select qid, string_agg(chunk_text, {lit(answering.CONTEXT_BREAK)} order by rank) as contexts, "
            "count(*)::int as n_contexts from hits group by qid"
        ),
        "source_preview": (
            f"with {search()} select qid, rank, filename, replace(substring(chunk_text, 1, 120), chr(10), ' ') as preview from hits"
        ),
        "cache_hits": f"with {CACHED} select doc_id, sha256(text) as text_sha from documents where sha256(text) in (select text_sha from cached)",
        "cache_misses": f"with {CACHED} select distinct sha256(text) as text_sha, text from documents where sha256(text) not in (select text_sha from cached)",
        "cache_merge": (
            f"select doc_id, sha256(text) as text_sha, array_to_string(list_transform({LETTER_VECTOR}, lambda x: x::bigint), ',') as embedding from documents"
        ),
        "prompt_table": (
            f"with {search()}, g as (select qid, string_agg(chunk_text, {lit(answering.CONTEXT_BREAK)} order by rank) as c from hits group by qid) "
            f"select qid, {lit(answering.SYSTEM)} as system, {lit(answering.BEFORE_CONTEXT)} || coalesce(c, '') || {lit(answering.BEFORE_QUESTION)} "
            f"|| question || {lit(answering.AFTER_QUESTION)} as human from items left join g using (qid)"
        ),
        "written_answers": (
            f"with {search(asked=ASKED)}, g as (select qid, string_agg(chunk_text, {lit(answering.CONTEXT_BREAK)} order by rank) as c from hits group by qid), "
            f"p as (select qid, question, {lit(answering.BEFORE_CONTEXT)} || coalesce(c, '') || {lit(answering.BEFORE_QUESTION)} "
            f"|| question || {lit(answering.AFTER_QUESTION)} as human from items left join g using (qid)) "
            "select qid, case when length(question) % 7 <> 0 then 'small 0.25 ' || length(human) || ': ' "
            "|| array_to_string(string_split(question, ' ')[1:4], ' ') end as answer, "
            "case when length(question) % 7 = 0 then 'OSError: busy' end as error from p"
        ),
        "extractive_answer": f"with {records()} select qid, answer from records",
        "rag_end_to_end": (
            f"with {records()} select qid, question, answer, array_to_string(contexts, {lit(answering.CONTEXT_BREAK)}) as contexts, "
            "len(contexts)::int as n_sources from records"
        ),
        "eval_records": (
            f"with {records()} select qid, question as user_input, answer as response, "
            f"array_to_string(contexts, {lit(answering.CONTEXT_BREAK)}) as retrieved_contexts, ground_truth as reference from records"
        ),
        "claims": (
            f"select doc_id, z[2]::int as claim_no, z[1] as claim from (select doc_id, unnest(list_zip(c, range(len(c)))) as z "
            f"from (select doc_id, {claims('text')} as c from documents))"
        ),
        "claim_verdicts": f"with {scores()} select qid, side, claim_no, claim, supported from verdicts",
        "scores_wide": f"with {scores()} select qid, {WIDE} from scores group by qid",
        "metric_aggregates": (
            f"with {scores()}, broken as (select experiment, metric, {BROKEN} as score from scores) "
            f"select {AGGREGATES} from broken group by experiment"
        ),
        "score_report": stats_rows(scores(asked=ASKED))
        + "select metric, repeat('█', least(greatest(trunc(mean * 20)::int, 0), 20)) || repeat('░', 20 - least(greatest(trunc(mean * 20)::int, 0), 20)) as bar, "
        "printf('%.4f ± %.4f', mean, std) as summary from stats",
        "score_bands": stats_rows(scores())
        + "select metric, mean, case when mean >= 0.85 then 'Excellent' when mean >= 0.7 then 'Good' when mean >= 0.55 then 'Acceptable' "
        "when mean >= 0.4 then 'Poor' else 'Very poor' end as band, mean >= case metric "
        + " ".join(f"when '{m}' then {t}" for m, t in THRESHOLDS.items())
        + " end as passed from stats",
        "k_sweep": stats_rows(scores(ks=K_VALUES)) + "from stats",
        "chunk_size_sweep": stats_rows(scores(SIZES)) + "from stats",
        "sweep_settings": (
            f"with {chunks(SIZES)} select experiment, 'chunk_size' as param_name, regexp_extract(experiment, '\\d+$') as param_value, "
            "regexp_extract(experiment, '\\d+$')::int as chunk_size, greatest(32, regexp_extract(experiment, '\\d+$')::int // 8) as chunk_overlap, "
            "4 as k, 'similarity' as search_type, count(*) as n_chunks from chunks group by experiment"
        ),
        "benchmark_summary": both_sweeps(
            f"select experiment, param_name, param_value, {WIDE_STATS} from all_scores group by experiment, param_name, param_value"
        ),
        "param_series": both_sweeps(
            "select param_name, param_value, experiment, case metric "
            + " ".join(f"when '{m}' then '{m.replace('_', ' ').title()}'" for m in METRICS)
            + " end as label, metric, mean, std, printf('%.3f', mean) as mean_label from stats"
        ),
        "metric_matrix": both_sweeps(
            "select experiment, " + ", ".join(f"max(mean) filter (where metric = '{m}') as {m}" for m in METRICS) + " from stats group by experiment"
        ),
        "stage_counts": (
            f"with {chunks()}, {CACHED} select 'documents' as stage, count(*) as n from documents union all "
            "select 'chunks', count(*) from chunks union all "
            "select 'cache_hits', count(*) from documents where sha256(text) in (select text_sha from cached) union all "
            "select 'cache_misses', count(distinct sha256(text)) from documents where sha256(text) not in (select text_sha from cached)"
        ),
    }
    for metric in METRICS:
        s[metric] = only(metric, ASKED if metric in ("answer_relevancy", "context_precision") else "text")

    models = (("embedding_full", 64), ("embedding_half", 32))
    parts = []
    for name, dims in models:
        center = CENTROIDS.rstrip(", ")
        short = UNIT.replace("embedding::double[] as e", f"embedding[1:{dims}]::double[] as e")
        parts.append(
            f"select '{name}' as experiment, qid, rank, relevant from (with {short} {center}, h as (select qid, label, row_number() over "
            "(partition by qid order by round(list_dot_product(q, v), 6) desc, vec_id) as rank from queries cross join unit) "
            "select qid, rank, label = qid as relevant from h where rank <= 4)"
        )
    s["embedding_sweep"] = (
        f"with relevant as ({' union all '.join(parts)}), running as (select *, sum(relevant::int) over (partition by experiment, qid order by rank) / rank as prec "
        "from relevant) select experiment, qid, 'context_precision' as metric, round(coalesce(avg(prec) filter (where relevant), 0), 6) as score "
        "from running group by experiment, qid"
    )

    found = [(f"low {m}", ADVICE[m], f"{m} < {THRESHOLDS[m]}") for m in METRICS]
    for *pair, cause in PATTERNS:
        name = " + ".join(f"{'low' if low else 'high'} {m}" for m, low in pair)
        rule = " and ".join(f"{m} {'<' if low else '>='} {THRESHOLDS[m]}" for m, low in pair)
        found.append((name, cause, rule))
    s["diagnosis"] = (
        stats_rows(scores(asked=ASKED))
        + ", w as (select experiment, "
        + ", ".join(f"max(mean) filter (where metric = '{m}') as {m}" for m in METRICS)
        + " from stats group by experiment) "
        + " union all ".join(f"select {lit(n)} as finding, {lit(a)} as advice from w where {rule}" for n, a, rule in found)
    )
    return s
