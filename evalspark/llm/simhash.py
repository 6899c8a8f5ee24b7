"""SimHash near-dedup by deletion variants: two 64-bit fingerprints with at most 3 different
bits agree in one of two halves up to one bit, so they share a half with that bit left out.

Each different fingerprint is indexed under its 64 one-wildcard halves. Rows of one key
come sorted to one task, which streams them: keys with few fingerprints are compared in
place with numpy, and only links that hold leave the task, for larger keys a spanning
forest instead of all pairs. A key with over ``BUCKET`` fingerprints is passed on and keyed
anew by one-wildcard quarters of its other half; such a key leaves 18 bits free, so it is
bounded. Groups are the connected parts of the links, found by alternating stars on tables.

Defined cases: no words, null and empty texts have fingerprint zero; rows that repeat an id
are judged one by one; a null ``doc_id`` is after all others, and a group of such rows alone
has a null ``component_id``; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.words import LAST, bounded_batches, in_slices, split_words, texts_of
from evalspark.session import stage

SHINGLE = 3
SEED = 42
NEAR = 3
BUCKET = 4096
# Rows that a task compares at once.
CHUNK = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(data: bytes) -> int:
    words = split_words(data.translate(_LOWER))
    if not words:
        return 0
    body, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(body, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.concatenate(([0], ends[: -SHINGLE]))
        hashes = [digest(body[a:b], SEED) for a, b in zip(begins.tolist(), (ends[SHINGLE - 1 :] - 1).tolist())]
    data = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(data[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, did, fp`` for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                yield doc, fingerprint(data)

    made = docs.select("doc_id", "text").mapInArrow(lambda b: in_slices(rows(b), schema), "doc_id bigint, fp bigint")
    return made.withColumn("did", F.coalesce("doc_id", F.lit(LAST)))


def squeezed(x: np.ndarray, width: int) -> np.ndarray:
    """For each value, ``width`` rows of a number for ``(position, value without that bit)``."""
    at = np.arange(width, dtype=np.uint64)
    x = x[:, None]
    low = x & ((np.uint64(1) << at) - np.uint64(1))
    high = x >> (at + np.uint64(1)) << at
    return at << np.uint64(width - 1) | high | low


def half_variants(fp: np.ndarray) -> np.ndarray:
    x = fp.view(np.uint64)
    low, high = squeezed(x & np.uint64(0xFFFFFFFF), 32), squeezed(x >> np.uint64(32), 32)
    return np.concatenate((low, high | np.uint64(1 << 62)), 1).view(np.int64)


def quarter_variants(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Numbers for one-wildcard quarters of the half that ``key`` is not about."""
    x = fp.view(np.uint64)
    other = np.where(key >> 62 & 1, x & np.uint64(0xFFFFFFFF), x >> np.uint64(32))
    low, high = squeezed(other & np.uint64(0xFFFF), 16), squeezed(other >> np.uint64(16), 16)
    return np.concatenate((low, high | np.uint64(1 << 20)), 1).view(np.int64)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= NEAR


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep the near fingerprints of one key connected, one less than each part has."""
    links, rest = [], fps
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            met = near(rest, x)
            found, rest = rest[met], rest[~met]
            stack += list(found)
            links += [(int(x), int(y)) for y in found]
    return links


def links_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole runs of equal keys."""
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]))))
    size = np.diff(np.append(first, len(keys)))
    run = np.repeat(size, size)
    a, b = [], []
    for lag in range(1, min(16, size.max(initial=1))):
        i = np.flatnonzero((keys[lag:] == keys[:-lag]) & (run[lag:] <= 16))
        i = i[near(fps[i], fps[i + lag])]
        a.append(fps[i])
        b.append(fps[i + lag])
    for at, k in zip(first[size > 16], size[size > 16]):
        for x, y in forest(fps[at : at + k]):
            a.append([x])
            b.append([y])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
    pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
    return pair[:, 0], pair[:, 1]


def linked(keyed: DataFrame, columns: list[str], bucket: int | None) -> DataFrame:
    """``a, b, over``: links among rows of equal ``columns``; with ``bucket``, rows of larger
    keys come back as ``(key, fp, true)``."""
    count = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = keyed.repartition(count, *columns).sortWithinPartitions(*columns, "fp")

    def out(a, b, over: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), over))], names=["a", "b", "over"]
        )

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(len(columns) + 1)]
        passing = None

        def done(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            # Columns of one key as one number: equal neighbours are what counts.
            new = np.zeros(len(rows[0]), bool)
            for c in rows[:-1]:
                new[1:] |= c[1:] != c[:-1]
            run = np.cumsum(new)
            fps = rows[-1]
            if bucket:
                big = np.bincount(run, minlength=1)[run] > bucket
                if big.any():
                    yield out(rows[0][big], fps[big], True)
                run, fps = run[~big], fps[~big]
            if len(fps):
                a, b = links_of(run, fps)
                if len(a):
                    yield out(a, b, False)

        for batch in found:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*columns, "fp")]
            if passing is not None:
                same = np.logical_and.reduce([c == p for c, p in zip(new[:-1], passing)])
                k = len(same) if same.all() else int(np.argmin(same))
                if k:
                    yield out(new[0][:k], new[-1][:k], True)
                    new = [c[k:] for c in new]
                if not len(new[0]):
                    continue
                passing = None
            held = [np.concatenate((h, c)) for h, c in zip(held, new)]
            if len(held[0]) < CHUNK:
                continue
            tail = np.logical_and.reduce([c == c[-1] for c in held[:-1]])
            cut = len(tail) - int(np.argmin(tail[::-1])) if not tail.all() else 0
            if cut:
                yield from done([c[:cut] for c in held])
                held = [c[cut:] for c in held]
            if bucket and len(held[0]) > bucket:
                passing = [c[0] for c in held[:-1]]
                yield out(held[0], held[-1], True)
                held = [c[:0] for c in held]
        if len(held[0]):
            yield from done(held)

    return sorted_rows.mapInArrow(batches, "a bigint, b bigint, over boolean")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``a < b``: enough links to connect all that are connected by links of at most 3 bits."""
    spark = fps.sparkSession

    def variants(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                key = half_variants(part)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part, key.shape[1]))], names=["key", "fp"])

    def finer(batches):
        for batch in batches:
            key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            for at in range(0, len(fp), 4096):
                k, part = key[at : at + 4096], fp[at : at + 4096]
                sub = quarter_variants(k, part)
                n = sub.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, n)), pa.array(sub.ravel()), pa.array(np.repeat(part, n))], names=["key", "sub", "fp"])

    found = stage(linked(fps.select("fp").mapInArrow(variants, "key bigint, fp bigint"), ["key"], bucket), spark)
    over = found.filter("over").select("a", "b").mapInArrow(finer, "key bigint, sub bigint, fp bigint")
    more = linked(over, ["key", "sub"], None)
    return found.filter("NOT over").select("a", "b").unionByName(more.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: smallest node of the part that each linked node is in.

    Alternating large and small stars; every round is a table in the shared folder, and the
    number of rounds grows with the logarithm of the longest chain or so.
    """
    spark = edges.sparkSession
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), spark)
    before = None
    while before != (state := mark(now)):
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(roots.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), spark)
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    made = stage(fingerprints(docs), docs.sparkSession)
    each = made.groupBy("fp").agg(F.min("did").alias("did"))
    root = components(links(each, bucket))
    placed = each.join(root, each["fp"] == root["node"], "left").select("fp", "did", F.coalesce("root", "fp").alias("root"))
    placed = stage(placed, docs.sparkSession)
    least = placed.groupBy("root").agg(F.min("did").alias("component_id"))
    by_fp = placed.join(least, "root").select("fp", "component_id")
    return made.join(by_fp, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("component_id") < LAST, F.col("component_id")).alias("component_id"),
    )
