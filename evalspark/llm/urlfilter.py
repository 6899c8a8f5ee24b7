"""URL filters by a cascade of Bloom filters, exact over the corpus's keys without joins.

A rule is a key ``host + path``. A url's keys are its host's suffixes with as many labels as
some rule's host has, each with the beginnings of its path that are as long as some rule's
path. The listed keys are encoded in the first filter; the keys of the whole corpus that
pass it without being listed are found in one scan and encoded in the second; the listed
keys that pass the second go to the third, and so on until none passes. A key that fails
level i is listed exactly if i is even, so over this universe the answer has no error.

Filters are arrays of 64-bit words that are built with aggregates and enter the plan as
scalar subqueries. A filter of over ``MOST_BITS`` bits is refused: rule lists beyond that
(some two million keys at the sizes used) have to be applied in parts. Block and allow
rules have a cascade each, the other's rules being part of the universe. DataFrame
functions only.

Defined cases: a null url, or one without ``://``, has empty host and path and no rule; a
url without a rule is allowed; rows are judged one by one, so repeats and null ids are
kept; among rules of one length the one with the longer host wins; without rules all urls
have the default verdict; other columns, whatever their names, are carried unless they have
the names of results.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.words import carrying
from evalspark.session import stage

MOST_BITS = 1 << 25
# Chance that a key passes a level it is not in: the first one, and the later ones.
FIRST_RATE, RATE = 2.0**-6, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` (A-Z lowered) and ``path``."""
    rest = F.when(F.contains("url", F.lit("://")), F.substr(F.col("url"), F.instr("url", "://") + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    blank = F.lit("")
    return pages.withColumns({"host": F.coalesce(F.translate(host, UPPER, LOWER), blank), "path": F.coalesce(path, blank)})


def keys_of(labels: list[int], lengths: list[int]) -> list[tuple[Column, Column]]:
    """``(key, host_size)`` of each kind, the key null where the url has none such."""
    found = []
    for k in labels:
        whole = F.size(F.split("host", r"\.")) >= k
        suffix = F.substring_index("host", ".", -k)
        for n in lengths:
            fits = whole & (F.col("host") != "") & (F.char_length("path") >= n)
            key = F.concat(suffix, F.substr(F.col("path"), F.lit(1), F.lit(n)))
            found.append((F.when(fits, key), F.char_length(suffix)))
    return found


class Level:
    """One Bloom filter: its words as a scalar subquery, and how keys are hashed to bits."""

    def __init__(self, keys: DataFrame, count: int, rate: float, salt: str):
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = 64 * max(1, math.ceil(1.44 * count * self.hashes / 64))
        if self.bits > MOST_BITS:
            raise ValueError(f"a filter of {self.bits} bits is more than {MOST_BITS}; apply the rules in parts")
        self.salt = salt
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")
        )
        filled = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m")).select(
            F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.bits // 64 - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words")
        )
        self.words = stage(filled, keys.sparkSession).scalar()

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(f"{self.salt}/{i}"), key), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        hit = [
            F.getbit(F.element_at(self.words, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
            for p in self.places(key)
        ]
        return functools.reduce(lambda a, b: a & b, hit)


class Cascade:
    """``listed`` (column ``key``) against the keys of ``universe``; both may repeat keys."""

    def __init__(self, listed: DataFrame, universe: DataFrame, salt: str):
        spark = listed.sparkSession
        inside = stage(listed.select("key").distinct(), spark)
        count = inside.count()
        self.levels: list[Level] = []
        if not count:
            return
        self.levels.append(Level(inside, count, FIRST_RATE, f"{salt}/0"))
        passed = universe.filter(self.levels[0].passes(F.col("key"))).select("key").distinct()
        # A small table: listed keys and the few others that pass.
        outside = stage(passed.join(inside, "key", "left_anti"), spark)
        own, other = outside, inside
        while count := own.count():
            self.levels.append(Level(own, count, RATE, f"{salt}/{len(self.levels)}"))
            own, other = stage(other.filter(self.levels[-1].passes(F.col("key"))), spark), own

    def has(self, key: Column) -> Column:
        """Membership: decided by the first level that the key fails."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


@carrying("url", results=("host", "path", "rule", "verdict"))
def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; rules are ``(verdict, host + path)``."""
    spark: SparkSession = pages.sparkSession
    if not rules:
        return with_parts(pages).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    table = spark.createDataFrame(rules, "verdict string, key string").withColumn("host", F.substring_index("key", "/", 1))
    labels = sorted({len(key.split("/", 1)[0].split(".")) for _, key in rules})
    lengths = sorted({len(key) - len(key.split("/", 1)[0]) for _, key in rules})
    parts = with_parts(pages)
    keys = keys_of(labels, lengths)
    every = parts.select(F.explode(F.array(*(key for key, _ in keys))).alias("key")).filter("key IS NOT NULL")
    universe = every.unionByName(table.select("key"))
    cascades = {v: Cascade(table.filter(F.col("verdict") == v), universe, v) for v in ("block", "allow")}

    # Steps of their own, so that keys and memberships are evaluated once.
    with_keys = parts.withColumns({f"_key{i}": key for i, (key, _) in enumerate(keys)} | {f"_host{i}": n for i, (_, n) in enumerate(keys)})
    verdict = {}
    for i in range(len(keys)):
        key = F.col(f"_key{i}")
        found = F.when(cascades["block"].has(key), F.lit("block")).when(cascades["allow"].has(key), F.lit("allow"))
        verdict[f"_verdict{i}"] = F.when(key.isNotNull(), found)
    told = [
        F.when(
            F.col(f"_verdict{i}").isNotNull(),
            F.struct(F.char_length(f"_key{i}").alias("size"), F.col(f"_host{i}").alias("host_size"), F.col(f"_key{i}").alias("key"), F.col(f"_verdict{i}").alias("verdict")),
        )
        for i in range(len(keys))
    ]
    best = F.array_max(F.array(*told))
    return with_keys.withColumns(verdict).withColumn("_best", best).select(
        *pages.columns, "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )
