"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample.

A rule is a condition that rejects a document. On a sample of some SAMPLE_ROWS rows, drawn
from the whole table, each rule's selectivity (part of the sample it rejects) and cost (seconds
to evaluate it alone, less those of a job without a rule) are measured; rules then stand in one
``CASE`` by rejection per cost. A measure that one rule alone uses is an expression inside that
rule's branch, so a document that an earlier rule rejects never pays for it; measures that
several rules share are computed once. The order changes the cost, never the verdict: a document
is kept if no rule rejects it. DataFrame functions only.

Measures of a text: words are ``[^\\x20\\x09-\\x0D]+``. Windows of 5 words that stand twice
are found per document by the hashes of its windows: if all differ there are none, else they are
sorted with their places, which takes n log n steps however long or repetitive the text is.
Neighbours with equal hashes are compared word by word; if two of them differ, that text is
sorted by the words of its windows in place of their hashes.

Defined cases: null and empty texts have no words and fail the base rule; rows are judged
one by one, so repeats and null ids are kept; ``judge`` carries columns of any name, and those
named ``kept`` and ``rejected_by`` are replaced. An empty table has an empty result, and without
rules every row is kept.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.session import stage

WINDOW = 5
SAMPLE_ROWS = 1000
# Timed runs of each job on the sample.
RUNS = 2
SPACES = " \t\n\x0b\x0c\r"

# A rule takes the measures by name, as columns, and gives the condition that rejects.
Rule = Callable[[Mapping[str, Column]], Column]
RULES: dict[str, Rule] = {
    "too_short": lambda m: m["n_words"] < 10,
    "repeats": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: (m["lines"]["dup"] > 2) & (10 * m["lines"]["dup"] > 3 * m["lines"]["all"]),
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
    "capitals": lambda m: 2 * m["n_capitals"] > m["word_chars"],
}
BASE = ("too_short", "repeats")
RESULTS = ("kept", "rejected_by")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_window_words(words: Column, kinds: int | None = None) -> Column:
    """Words covered by windows that stand twice or more, the first included.

    ``kinds`` cuts hashes down to so many, to test what happens when they are equal by chance.
    """

    def count(w: Column) -> Column:
        n = F.size(w)

        def window_hash(h: Column, i: Column) -> Column:
            found = F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
            return F.pmod(found, F.lit(kinds)) if kinds else found

        def hashes(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: window_hash(h, i))

        def text_of(x: Column) -> Column:
            return F.slice(w, x["i"] + 1, WINDOW)

        def covered(s: Column) -> Column:
            # s: windows by key, then place. A place counts if a neighbour has its key.
            last = F.size(s) - 1
            same = lambda a, b: a["key"] == b["key"]
            twice = F.filter(
                s,
                lambda x, j: ((j > 0) & same(F.get(s, F.greatest(j - 1, F.lit(0))), x))
                | ((j < last) & same(F.get(s, F.least(j + 1, last)), x)),
            )
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(
                places, start,
                lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
                lambda a: a["n"],
            )

        def by_words() -> Column:
            pairs = F.transform(
                F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.slice(w, i + 1, WINDOW).alias("key"), i.alias("i"))
            )
            return let(F.array_sort(pairs), covered)

        def sorted_hashes(s: Column) -> Column:
            # Windows of one hash that are not all alike have neighbours that differ.
            chance = F.filter(
                s,
                lambda x, j: (j > 0)
                & (F.get(s, F.greatest(j - 1, F.lit(0)))["key"] == x["key"])
                & (text_of(F.get(s, F.greatest(j - 1, F.lit(0)))) != text_of(x)),
            )
            return F.when(F.size(chance) > 0, by_words()).otherwise(covered(s))

        def told(k: Column) -> Column:
            pairs = F.transform(k, lambda x, i: F.struct(x.alias("key"), i.alias("i")))
            return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(F.array_sort(pairs), sorted_hashes))

        word_hashes = F.transform(w, lambda x: F.xxhash64(x))
        return F.when(n > WINDOW, let(let(word_hashes, hashes), told)).otherwise(F.lit(0))

    return let(words, count).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Each measure of a text as an expression; ``lines`` is a struct of all lines with a word and
    those equal to an earlier one."""
    text = F.coalesce(text, F.lit(""))

    def without(marks: str) -> Column:
        return F.char_length(F.translate(text, marks, ""))

    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return {
        "n_words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        "word_chars": without(SPACES).cast("long"),
        "n_symbols": (F.char_length(text) - without("#*$%&|<>")).cast("long"),
        "n_capitals": (F.char_length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long"),
        "n_repeat_words": repeated_window_words(words_of(text)),
        "lines": let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")
            ),
        ),
    }


class Asked(dict):
    """Measures that note which of them a rule asks for."""

    def __init__(self, found: Mapping[str, Column]):
        super().__init__(found)
        self.names: set[str] = set()

    def __getitem__(self, name: str) -> Column:
        self.names.add(name)
        return super().__getitem__(name)


def shared_measures(rules: Mapping[str, Rule]) -> list[str]:
    """Measures that more than one rule asks for."""
    uses: Counter[str] = Counter()
    found = measures(F.col("text"))
    for rule in rules.values():
        asked = Asked(found)
        rule(asked)
        uses.update(asked.names)
    return sorted(name for name, n in uses.items() if n > 1)


def prepared(docs: DataFrame, rules: Mapping[str, Rule]) -> tuple[DataFrame, dict[str, Column]]:
    """``row`` (all columns of ``docs``) and ``shared``, with the measures to give to rules: shared
    ones as columns, the others as expressions that cost nothing until a branch evaluates them."""
    found = measures(F.col("row.text"))
    shared = shared_measures(rules)
    table = docs.select(F.struct("*").alias("row"))
    if shared:
        table = table.select("row", F.struct(*[found[name].alias(name) for name in shared]).alias("shared"))
    return table, found | {name: F.col("shared")[name] for name in shared}


def rule_order(
    docs: DataFrame, rules: Mapping[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS
) -> list[tuple[str, float, float]]:
    """``(rule, rejected part, seconds)`` of a sample of about ``sample_rows``, best first.

    A job is one task over the sample. It runs RUNS times, the first of which compiles it, and its
    fastest run counts. Costs below what later runs of the job without a rule differ by cannot be
    told apart and count as that.
    """
    total = max(1, docs.count())
    sample = stage(docs.select("text").sample(min(1.0, sample_rows / total), seed=7), docs.sparkSession)
    rows = max(1, sample.count())
    table, given = prepared(sample.coalesce(1), rules)

    def timed(condition: Column, runs: int = RUNS) -> tuple[int, list[float]]:
        # The shared part is asked for in every job, so that it falls out of the difference.
        shared = [F.max(F.hash("shared"))] if "shared" in table.columns else []
        job = table.agg(F.count_if(condition), *shared)
        seconds, rejected = [], 0
        for _ in range(runs):
            start = time.perf_counter()
            rejected = job.first()[0]
            seconds.append(time.perf_counter() - start)
        return rejected, seconds[1:]

    _, empty = timed(F.col("row.text").isNull(), RUNS + 1)
    least = max(max(empty) - min(empty), 0.001)
    found = []
    for name, rule in rules.items():
        rejected, seconds = timed(rule(given))
        found.append((name, rejected / rows, max(min(seconds) - min(empty), least)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def cascade(order: Sequence[str], rules: Mapping[str, Rule], given: Mapping[str, Column]) -> Column:
    """The first rule that rejects, null if none does; later ones are not evaluated."""
    first = F.lit(None).cast("string")
    for name in reversed(order):
        first = F.when(rules[name](given), F.lit(name)).otherwise(first)
    return first


def judge(
    docs: DataFrame, rules: Mapping[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS, order: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with ``kept`` (no rule rejects the row) and ``rejected_by`` (the first rule that did).

    ``order`` gives the order of the rules in place of a sample.
    """
    order = [name for name, _, _ in rule_order(docs, rules, sample_rows)] if order is None else order
    table, given = prepared(docs, rules)
    carried = [F.col("row")[name].alias(name) for name in docs.columns if name not in RESULTS]
    told = table.select("row", cascade(order, rules, given).alias("rule"))
    return told.select(*carried, F.col("rule").isNull().alias("kept"), F.col("rule").alias("rejected_by"))


def report(docs: DataFrame, rules: Mapping[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed`` and ``kept`` of each row.

    Base measures are returned for every row, so only what no column shows is left to the cascade.
    """
    order = [name for name, _, _ in rule_order(docs, rules, sample_rows)]
    found = measures(F.col("text"))
    # One split gives both the number of words and their windows.
    words = let(
        words_of(F.coalesce("text", F.lit(""))),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).alias("again")),
    )
    table = docs.select(
        "doc_id", "text", words.alias("words"), found["word_chars"].alias("word_chars"),
        found["n_symbols"].alias("n_symbols"), found["lines"].alias("lines"),
    )
    given = found | {name: F.col(name) for name in ("word_chars", "n_symbols", "lines")}
    given |= {"n_words": F.col("words.n"), "n_repeat_words": F.col("words.again")}
    base = reduce(lambda x, y: x | y, (rules[name](given) for name in BASE if name in rules), F.lit(False))
    return table.select(
        "doc_id", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"),
        F.col("words.again").alias("n_repeat_words"), base.alias("base_failed"),
        cascade(order, rules, given).isNull().alias("kept"),
    )
