"""The cascade of quality rules: verdicts by brute force, and what a rejected row never pays for."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from evalspark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeat_words(text):
    w = WORD.findall(text or "")
    places = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, hit = collections.Counter(places), set()
    for i, window in enumerate(places):
        if seen[window] > 1:
            hit.update(range(i, i + 5))
    return len(hit)


def rejections(text):
    """The rules that reject a text."""
    text = text or ""
    w = WORD.findall(text)
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    told = {
        "too_short": n < 10,
        "repeats": 100 * repeat_words(text) > 20 * n,
        "symbols": 10 * len(re.findall(r"[#*$%&|<>]", text)) > n,
        "repeated_lines": dup > 2 and 10 * dup > 3 * len(lines),
        "word_length": chars < 2 * n or chars > 20 * n,
        "capitals": 2 * len(re.findall("[A-Z]", text)) > chars,
    }
    return {name for name, bad in told.items() if bad}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = ["a", "b", "c", "aa", "Bb", "CC", "#", "é", "x" * 30]
    few = [" ".join(rng.choices(letters[: rng.randint(1, 9)], k=rng.randint(0, 60))) for _ in range(150)]
    lines = ["\n".join(rng.choices(["one two three", "four five", " ", "LOUD WORDS HERE NOW"], k=rng.randint(1, 12))) for _ in range(60)]
    clean = [" ".join(f"word{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(30)]
    return [None, "", " \n", *few, *lines, *clean, "same " * 3000, " ".join(map(str, range(4000)))]


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)


def test_judge_equals_brute_force(table, texts):
    got = {r.doc_id: r for r in rules.judge(table).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        bad = rejections(text)
        assert got[i].kept == (not bad), i
        assert got[i].rejected_by in bad if bad else got[i].rejected_by is None


def test_report_keeps_what_judge_keeps(table, texts):
    for r in rules.report(table).collect():
        bad = rejections(texts[r.doc_id])
        assert r.kept == (not bad) and r.base_failed == bool(bad & set(rules.BASE))


@pytest.mark.parametrize("kinds", [None, 1, 2, 7])
def test_equal_hashes_by_chance(table, texts, kinds):
    found = table.select("doc_id", "text", rules.repeated_window_words(rules.words_of(F.coalesce("text", F.lit(""))), kinds).alias("n"))
    for r in found.filter("length(text) < 5000 OR text IS NULL").collect() if kinds else found.collect():
        assert r.n == repeat_words(texts[r.doc_id]), r.doc_id


def test_rejected_rows_do_not_pay(table, texts):
    dear = {
        "early": lambda m: m["n_words"] < 50,
        # Ends the job for any row it is evaluated on that has a word.
        "dear": lambda m: F.when(m["n_repeat_words"] >= 0, F.raise_error(F.lit("evaluated"))).cast("boolean"),
    }
    short = table.filter("length(text) < 50 OR text IS NULL")
    assert short.count() > 10
    assert {r.rejected_by for r in rules.judge(short, dear, order=["early", "dear"]).collect()} == {"early"}
    with pytest.raises(Exception, match="evaluated"):
        rules.judge(short, dear, order=["dear", "early"]).collect()


def test_measures_of_one_rule_stay_in_its_branch(table):
    assert rules.shared_measures(rules.RULES) == ["n_words", "word_chars"]


def test_order_by_rejection_per_cost(table):
    found = rules.rule_order(table)
    assert {name for name, _, _ in found} == set(rules.RULES)
    values = [part / seconds for _, part, seconds in found]
    assert values == sorted(values, reverse=True) and all(seconds > 0 for _, _, seconds in found)
    # A rule that rejects nothing stands behind all that reject something.
    never = rules.RULES | {"never": lambda m: m["n_words"] < 0}
    assert rules.rule_order(table, never)[-1][0] == "never"


def test_any_column_names_and_no_rules(spark):
    names = ["row", "shared", "rule", "lines", "n_words", "word_chars", "kept", "words"]
    docs = spark.createDataFrame([(1, "too short", *range(8)), (1, "too short", *range(8))], ["doc_id", "text", *names])
    got = rules.judge(docs).collect()
    assert len(got) == 2
    for r in got:
        assert [r[n] for n in names if n != "kept"] == [0, 1, 2, 3, 4, 5, 7]
        assert r.kept is False and r.rejected_by in ("too_short", "repeats", "symbols")
    assert [r.kept for r in rules.judge(docs, {}).collect()] == [True, True]
    assert rules.judge(docs.limit(0)).count() == 0
    assert rules.report(docs).count() == 2
