"""Spelling variants by permuterm rotations: words that differ by one character, and for each
word the much more frequent one it is taken to be a slip of.

A word is marked with a terminator and rotated. The rotation that has the character at place
``i`` last reads ``rest $ start x``: without its last character it is the same for all words
that have another character there, and it is the whole rotation of the word that has none.
So replacements and indels are prefix ranges that skip the edited character: all rotations
are put in order by that prefix (a shuffle and sort by it), and each range is scanned once.
A range holds at most one word per character of the alphabet and one without.

No pairs are made: in a range a word has all others as neighbours, so it is given their number
and the best of them, which is the first of the range or, for that word, the second. A pair
that differs by a replacement meets in one range. One that differs by an indel in a run of
equal characters meets once per character of the run; it is counted where the first of the
run is skipped only.

Words are counted per task before the shuffle, so frequent words are no hot keys. Forms are
followed to the last by pointer doubling over tables; each step of a chain has at least
``RATIO`` times the count, so there are few rounds.

Defined cases: null and empty texts have no words; a null ``doc_id`` reads as an empty string
in the mark of a slip; rows that repeat an id count each; ties go to the smallest word in
code-point order; other columns are not read. No words give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.words import bounded_batches, in_slices
from evalspark.session import stage

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
# What a word is made of, and the mark of its end, which is none of these.
LETTERS = "A-Za-zÀ-ÿ"
END = "$"
# Different words that a task holds before it passes their counts on.
HELD = 200_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, slip: int | None = None) -> DataFrame:
    """``word, n``: runs of letters of ``text`` with at least ``least`` characters, A-Z lower-cased.

    With ``slip``, one in so many (document, word) has a character left out: where the CRC-32 of
    ``<doc_id>:<word>`` is a multiple of it, the character at that number modulo the length.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    # Shorter runs have no place from which this fits, longer ones fit whole.
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def counted(doc: int | None, text: str) -> Iterator[tuple[str, int]]:
        start = crc32(f"{'' if doc is None else doc}:".encode())
        each: Counter[str] = Counter()
        for run, n in Counter(runs.findall(text)).items():
            each[run.translate(_LOWER)] += n
        for word, n in each.items():
            if slip:
                mark = crc32(word.encode(), start)
                if mark % slip == 0:
                    at = mark % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
            yield word, n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        held: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in counted(doc, text or ""):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield from held.items()
                    held.clear()
        yield from held.items()

    made = docs.select("doc_id", "text").mapInArrow(lambda b: in_slices(rows(b), schema), "word string, n bigint")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """``key, word, n, whole, first``: each rotation of the marked words as a whole (``whole``) and
    without its last character; ``first``: that character is the first of its run."""
    size = F.char_length("word")

    def turned(i):
        """Both rows for place ``i``, the place behind the word having the whole rotation only."""
        start, char = F.substring("word", F.lit(1), i), F.substring("word", i + 1, F.lit(1))
        behind = F.concat(F.lit(END), start)
        whole = F.struct(
            F.concat(F.substring("word", i + 1, size), behind).alias("key"),
            F.lit(True).alias("whole"), F.lit(False).alias("first"),
        )
        skipped = F.struct(
            F.concat(F.substring("word", i + 2, size), behind).alias("key"),
            F.lit(False).alias("whole"), ((i == 0) | (F.substring("word", i, F.lit(1)) != char)).alias("first"),
        )
        return F.when(i < size, F.array(whole, skipped)).otherwise(F.array(whole))

    rows = F.flatten(F.transform(F.sequence(F.lit(0), size), turned))
    return words.select("word", "n", F.explode(rows).alias("r")).select("r.key", "word", "n", "r.whole", "r.first")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: how many words differ by one character, and the ``(n, word)`` of the
    most frequent of them. Words without any are left out."""
    ranged = Window.partitionBy("key")
    scanned = ranged.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    this = F.struct(F.col("n"), F.col("word"))
    held = rotations(words).select(
        "word", "whole", "first",
        F.first(this).over(scanned).alias("one"), F.nth_value(this, 2).over(scanned).alias("two"),
        F.count(F.when(~F.col("whole"), 1)).over(scanned).alias("edited"),
        F.count(F.when(F.col("first"), 1)).over(scanned).alias("firsts"),
        F.max("whole").over(scanned).alias("has_whole"),
    ).filter("two IS NOT NULL")
    met = F.when(F.col("whole"), F.col("firsts")).otherwise(
        F.col("edited") - 1 + (F.col("first") & F.col("has_whole")).cast("long")
    )
    best = F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one"))
    return (
        held.select("word", met.alias("met"), best.alias("best"))
        .groupBy("word")
        .agg(F.sum("met").alias("n_near"), F.min(F.struct((-F.col("best.n")).alias("less"), F.col("best.word").alias("word"))).alias("b"))
        .select("word", "n_near", F.struct((-F.col("b.less")).alias("n"), F.col("b.word").alias("word")).alias("best"))
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` for each row of ``word, form``: forms followed to one that has none."""
    spark = forms.sparkSession
    now = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), spark)
    while not now.filter("open").isEmpty():
        onward = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = now.join(onward, now["root"] == onward["_at"], "left")
        now = stage(
            step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open")), spark
        )
    return now.select("word", "root")


def variant_groups(counts: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the rows of ``word, n`` with at least ``least``.

    The form of a word is its neighbour of largest count if that is ``ratio`` times its own.
    """
    spark = counts.sparkSession
    words = stage(counts.filter(F.col("word").isNotNull() & (F.col("n") >= least)).select("word", F.col("n").cast("long").alias("n")), spark)
    fits = F.col("best.n") >= ratio * F.col("n")
    found = stage(
        words.join(near_words(words), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best.word")).alias("form"), F.when(fits, F.col("best.n")).alias("form_n"),
        ),
        spark,
    )
    roots = last_forms(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
