"""Where equal windows of symbols may stand: the plan that both repeat removers share.

A window is ``width`` consecutive symbols (words or bytes) of one text. Equal windows have
the same smallest hash among their ``gram``-symbol pieces, their *key*. So:

1. ``sketch``: one scan gives each text its size and the keys of its windows, a few per
   hundred symbols. Equal texts are then one text, owned by the smallest ``doc_id``.
2. ``flagged``: keys that two texts, or two places of a text, have. Only their windows
   can repeat. Counting is a plain aggregation, so a hot key is combined before the shuffle.
3. ``segments``: runs of consecutive windows with one flagged key are cut out. Equal
   segments are combined to their first place before the shuffle; all windows of a later
   place have an earlier equal, so only first places need an index.
4. Segments meet by key in shards of bounded size. ``index`` tells for each shard which
   windows of a segment start earlier elsewhere. A key with very many different segments
   (a common passage in ever new surroundings) is in no shard: it is split into single
   windows, and equal ones are combined to their first place before the shuffle.
5. ``verdicts``: the answers go back to the texts, which lose every covered symbol.

Every window is in exactly one segment, so results do not depend on the hashes: equal
windows always meet, and the index compares symbols, not hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.words import EMPTY_SHA, LAST, bounded_batches, give_back, in_slices, stage_tidy, texts_of

# Symbols of a text that are hashed at once, and windows of a segment at most.
PIECE = 1 << 18
LONGEST = 256
# Different segments of a key beyond which it is dealt out as single windows.
HOT_KEY = 2000
# Symbols of all shards of a task, where there are more shards than tasks.
TASK = 16 << 20


@dataclass(frozen=True)
class Kind:
    """Symbols of a text: ``split`` to a sequence that slices, ``hashes`` of it as uint64,
    ``join`` a slice back to bytes."""

    width: int
    gram: int
    split: Callable
    hashes: Callable
    join: Callable


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads its bits; the lowest bit is then cleared."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(33))) & ~np.uint64(1)


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` consecutive values, by doubling."""
    out, done = x, 1
    while done < gram:
        step = min(done, gram - done)
        out = out[: len(out) - step] * np.uint64(0x9E3779B97F4A7C15 + 2 * done) + (out[step:] ^ (out[step:] >> np.uint64(29)))
        done += step
    return mixed(out)


def sliding(best: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``size`` consecutive values."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


def minima(kind: Kind, symbols) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram, and the smallest of each window."""
    gram = gram_hashes(kind.hashes(symbols), kind.gram)
    return gram, sliding(np.minimum, gram, kind.width - kind.gram + 1)


def key_places(kind: Kind, symbols) -> np.ndarray:
    """The keys of all windows, each as often as it stands in the text."""
    n, size = len(symbols) - kind.width + 1, kind.width - kind.gram + 1
    found = [np.zeros(0, np.uint64)]
    for at in range(0, max(n, 0), PIECE):
        gram, key = minima(kind, symbols[at : min(at + PIECE, n) + kind.width - 1])
        # A gram is a key if it is the smallest of one of the windows around it.
        edge = np.zeros(size - 1, np.uint64)
        found.append(gram[gram == sliding(np.maximum, np.concatenate((edge, key, edge)), size)])
    return np.concatenate(found).view(np.int64)


def runs(kind: Kind, symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number and key of each run of consecutive windows with one key."""
    n = len(symbols) - kind.width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, keys = [], []
    for at in range(0, n, PIECE):
        _, key = minima(kind, symbols[at : min(at + PIECE, n) + kind.width - 1])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        if size.max() > LONGEST:
            cut = [np.arange(a, a + k, LONGEST) for a, k in zip(first, size)]
            first = np.concatenate(cut)
        starts.append(first + at)
        keys.append(key[first])
    start = np.concatenate(starts)
    return start, np.diff(np.append(start, n)), np.concatenate(keys).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, did, cid, text``: place in the order, and identity of the text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("did"), F.unhex(F.md5(text)).alias("cid"), text.alias("text")
    )


def packed(kind: Kind, texts: DataFrame) -> DataFrame:
    """``did, cid, packed, full``: texts as they travel, with zstd and their size before it."""
    schema = pa.schema([("did", pa.int64()), ("cid", pa.binary()), ("packed", pa.binary()), ("full", pa.int64())])

    def rows(batches):
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for did, cid, data in zip(batch.column("did").to_pylist(), batch.column("cid").to_pylist(), texts_of(batch, "text")):
                body = kind.join(kind.split(data))
                yield did, cid, codec.compress(body, asbytes=True), len(body)

    return texts.select("did", "cid", "text").mapInArrow(lambda b: in_slices(rows(b), schema, 2), "did bigint, cid binary, packed binary, full bigint")


def unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    codec = pa.Codec("zstd", 1)
    for data, full in zip(batch.column("packed"), batch.column("full").to_pylist()):
        yield codec.decompress(data.as_buffer(), full, asbytes=True) if full else b""


def sketch(kind: Kind, docs: DataFrame, spark: SparkSession) -> DataFrame:
    """``doc_id, did, cid, n, sha, keys``; the lowest bit of a key tells that the text has it twice."""
    schema = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("cid", pa.binary()), ("n", pa.int64()), ("sha", pa.string()), ("keys", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids = (batch.column(c).to_pylist() for c in ("doc_id", "did", "cid"))
            for doc, did, cid, data in zip(*ids, texts_of(batch, "text")):
                symbols = kind.split(data)
                found, count = np.unique(key_places(kind, symbols), return_counts=True)
                sha = hashlib.sha256(kind.join(symbols)).hexdigest()
                yield doc, did, cid, len(symbols), sha, found | (count > 1)

    return stage_tidy(keyed(docs).mapInArrow(lambda b: in_slices(rows(b), schema, 5), SKETCH), spark)


SKETCH = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("did", T.LongType()), T.StructField("cid", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType()))]
)


def flagged(sketched: DataFrame) -> DataFrame:
    """``did, cid, keys``: texts with keys that stand elsewhere too, the bit kept; one row per text.

    Keys travel with 64 bits of their text's identity; texts that have these in common are
    looked at for each other's keys, nothing more.
    """
    texts = sketched.groupBy("cid").agg(F.min("did").alias("did"), F.any_value("keys").alias("keys"))
    short = F.xxhash64("cid").alias("tid")
    places = texts.select(short, F.explode("keys").alias("k"))
    key = F.col("k").bitwiseAND(-2).alias("key")
    times = F.sum((F.col("k").bitwiseAND(1) + 1).cast("int")).alias("n")
    shared = places.groupBy(key).agg(times).filter("n > 1").select("key")
    # Half of one side's keys are in the other, so hashing beats sorting both.
    met = places.join(shared.hint("shuffle_hash"), places["k"].bitwiseAND(-2) == shared["key"]).groupBy("tid").agg(F.collect_list("k").alias("keys"))
    owners = sketched.groupBy("cid").agg(F.min("did").alias("did")).withColumn("tid", F.xxhash64("cid"))
    return owners.join(met, "tid").select("did", "cid", "keys")


WORK = "did bigint, cid binary, packed binary, full bigint, starts array<int>, sizes array<int>, keys array<bigint>"


def work_table(kind: Kind, docs: DataFrame, marked: DataFrame, spark: SparkSession) -> DataFrame:
    """Texts with flagged keys and the segments to look at; the only time that texts move whole."""
    schema = pa.schema([("did", pa.int64()), ("cid", pa.binary()), ("packed", pa.binary()), ("full", pa.int64()), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64()))])

    def rows(batches):
        for batch in batches:
            ids = (batch.column(c).to_pylist() for c in ("did", "cid", "packed", "full"))
            for did, cid, data, full, body, wanted in zip(*ids, unpacked(batch), batch.column("keys")):
                symbols = kind.split(body)
                start, size, key = runs(kind, symbols)
                wanted = np.sort(wanted.values.to_numpy(zero_copy_only=False))
                met = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)]
                own = met & ~np.int64(1) == key
                yield did, cid, data, full, start[own], size[own], met[own]

    met = packed(kind, keyed(docs)).join(marked, ["did", "cid"])
    return stage_tidy(met.mapInArrow(lambda b: in_slices(rows(b), schema, 2), WORK), spark)


SEGMENT = "key bigint, segment binary, size int, twice int, did bigint, tid bigint, start int"


def segments(kind: Kind, work: DataFrame) -> DataFrame:
    """``key, segment, size, twice, first (did, tid, start)``: each different segment, its first place."""
    schema = pa.schema([("key", pa.int64()), ("segment", pa.binary()), ("size", pa.int32()), ("twice", pa.int32()), ("did", pa.int64()), ("tid", pa.int64()), ("start", pa.int32())])

    def rows(batches):
        for batch in batches:
            ids = (batch.column(c).to_pylist() for c in ("did", "tid", "starts", "sizes", "keys"))
            for did, tid, starts, sizes, keys, body in zip(*ids, unpacked(batch)):
                symbols = kind.split(body)
                for start, size, key in zip(starts, sizes, keys):
                    yield key & -2, kind.join(symbols[start : start + size + kind.width - 1]), size, key & 1, did, tid, start

    cut = work.drop("cid").mapInArrow(lambda b: in_slices(rows(b), schema, 1), SEGMENT)
    return cut.groupBy("key", "segment", "size").agg(
        F.max("twice").alias("twice"), F.min(F.struct("did", "tid", "start")).alias("first")
    )


def dealt(kind: Kind, found: DataFrame, shard: int) -> tuple[DataFrame, DataFrame]:
    """``(alone, sharded)``: places that are first without an index, and ``shard, key, segment, size, did, tid, start``.

    A key with one segment that it stands in once has no two equal windows; of a hot key
    each different window has one first place. Segments of other keys that may share
    windows are in one shard.
    """
    met = f"(n > 1 OR twice > 0) AND n <= {HOT_KEY}"
    counts = found.groupBy("key").agg(
        F.count("*").alias("n"), F.max("twice").alias("twice"), F.sum(F.col("size") + kind.width).alias("symbols")
    )
    symbols, hot = counts.agg(F.sum(F.when(F.expr(met), F.col("symbols"))), F.count_if(F.col("n") > HOT_KEY)).first()
    symbols = symbols or 0
    count = max(1, -(-symbols // shard))
    flat = found.select("key", "segment", "size", "first.did", "first.tid", "first.start")
    alone = flat.join(counts.filter("n = 1 AND twice = 0").select("key"), "key").select("did", "tid", "start", "size")
    if hot:
        alone = alone.unionByName(first_windows(kind, flat.join(counts.filter(F.col("n") > HOT_KEY).select("key"), "key")))
    several = flat.join(counts.filter(met).select("key"), "key")
    # A task holds many shards, one at a time, so tasks need not grow in number as shards do.
    tasks = min(count, max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-symbols // TASK)))
    sharded = several.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(count)))
    return alone, sharded.repartition(tasks, "shard").sortWithinPartitions("shard")


def first_windows(kind: Kind, several: DataFrame) -> DataFrame:
    """``did, tid, start, size``: the first place of each different window of these segments."""
    schema = pa.schema([("key", pa.int64()), ("window", pa.binary()), ("did", pa.int64()), ("tid", pa.int64()), ("start", pa.int32())])

    def rows(batches):
        for batch in batches:
            for key, body, size, did, tid, start in zip(*(batch.column(c).to_pylist() for c in ("key", "segment", "size", "did", "tid", "start"))):
                parts = kind.split(body)
                for j in range(size):
                    yield key, kind.join(parts[j : j + kind.width]), did, tid, start + j

    cut = several.mapInArrow(lambda b: in_slices(rows(b), schema, 1), "key bigint, window binary, did bigint, tid bigint, start int")
    first = cut.groupBy("key", "window").agg(F.min(F.struct("did", "tid", "start")).alias("first"))
    return first.select("first.did", "first.tid", "first.start", F.lit(1).alias("size"))


ANSWER = "did bigint, tid bigint, start int, size int, earlier binary"


def answers(kind: Kind, table: DataFrame, index: Callable) -> DataFrame:
    """``ANSWER`` rows: for the segment at this place, a bit for each window that starts earlier elsewhere.

    Rows of ``table`` come shard by shard. ``index(segments, sizes, order, keys)`` gets one shard: lists of symbols, windows of each,
    the rank of each place and the keys, and returns a boolean array per segment.
    """
    schema = pa.schema([("did", pa.int64()), ("tid", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("earlier", pa.binary())])

    def one(rows: list[tuple]) -> Iterator[tuple]:
        places = [(did, tid) for _, _, _, did, tid, _ in rows]
        rank = {p: i for i, p in enumerate(sorted(set(places)))}
        order = np.array([(rank[p] << 32) + r[5] for p, r in zip(places, rows)], np.int64)
        masks = index([kind.split(r[1]) for r in rows], np.array([r[2] for r in rows]), order, [r[0] for r in rows])
        for (_, _, size, did, tid, start), mask in zip(rows, masks):
            yield did, tid, start, size, np.packbits(mask).tobytes() if mask.any() else None

    def rows(batches):
        now, held = None, []
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "segment", "size", "did", "tid", "start"))):
                if shard != now and held:
                    yield from one(held)
                    held = []
                    give_back()
                now = shard
                held.append(tuple(row))
        if held:
            yield from one(held)

    return table.mapInArrow(lambda b: in_slices(rows(b), schema), ANSWER)


VERDICT = "cid binary, n_removed bigint, n_spans bigint, sha string, kept binary"


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of these starts and sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def verdicts(kind: Kind, work: DataFrame, told: DataFrame, with_text: bool) -> DataFrame:
    """``VERDICT`` of each text in ``work`` that loses something: segments that no answer names
    are later places."""
    schema = pa.schema([("cid", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string()), ("kept", pa.binary())])

    def rows(batches):
        codec = pa.Codec("zstd", 1)
        number = lambda x: x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)
        for batch in batches:
            for cid, data, full, *lists, told in zip(*(batch.column(c) for c in ("cid", "packed", "full", "starts", "sizes", "at", "long", "earlier"))):
                starts, sizes, at, long = map(number, lists)
                earlier = np.zeros(int((starts + sizes).max(initial=0)), bool)
                earlier[ranges(starts, sizes)] = True
                earlier[ranges(at, long)] = False
                bits = told.values if told.is_valid else ()
                for i in np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False)) if len(bits) else ():
                    a, k = at[i], long[i]
                    earlier[a : a + k] = np.unpackbits(np.frombuffer(bits[i].as_buffer(), np.uint8), count=k)
                if not earlier.any():
                    continue
                symbols = kind.split(codec.decompress(data.as_buffer(), full.as_py(), asbytes=True))
                edge = np.diff(earlier.astype(np.int8), prepend=0, append=0)
                count = np.zeros(len(symbols) + kind.width + 1, np.int32)
                np.add.at(count, np.flatnonzero(edge == 1), 1)
                np.add.at(count, np.flatnonzero(edge == -1) + kind.width - 1, -1)
                gone = np.cumsum(count)[: len(symbols)] > 0
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = kept_part(kind, symbols, gone)
                yield cid.as_py(), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), whole_characters(kept) if with_text else b""

    by_text = told.groupBy("did", "tid").agg(F.collect_list(F.struct("start", "size", "earlier")).alias("told"))
    met = work.drop("keys").join(by_text, ["did", "tid"], "left").select(
        "cid", "packed", "full", "starts", "sizes",
        F.col("told.start").alias("at"), F.col("told.size").alias("long"), F.col("told.earlier").alias("earlier"),
    )
    return met.mapInArrow(lambda b: in_slices(rows(b), schema, 4), VERDICT)


def whole_characters(data: bytes) -> bytes:
    """UTF-8 without the rest of characters that a cut has split."""
    return data.decode("utf-8", "ignore").encode()


def kept_part(kind: Kind, symbols, gone: np.ndarray) -> bytes:
    if isinstance(symbols, bytes):
        return np.frombuffer(symbols, np.uint8)[~gone].tobytes()
    return kind.join([x for x, g in zip(symbols, gone.tolist()) if not g])


def find(kind: Kind, docs: DataFrame, index: Callable, shard: int, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(decisions, verdicts)``: per row of ``docs`` what is left of it, and the texts that lost something.

    Decisions: ``doc_id, did, cid, n, n_removed, n_spans, sha, copy``; a copy has an equal
    text with a smaller ``doc_id`` and loses everything if it holds a window at all.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sketched = sketch(kind, docs, spark)
    work = work_table(kind, docs, flagged(sketched), spark).withColumn("tid", F.xxhash64("cid"))
    found = stage_tidy(segments(kind, work), spark)
    alone, sharded = dealt(kind, found, shard)
    told = answers(kind, sharded, index).unionByName(alone.withColumn("earlier", F.lit(None).cast("binary")))
    lost = verdicts(kind, work, told, with_text)
    if with_text:
        lost = stage_tidy(lost, spark)
    owners = sketched.groupBy("cid").agg(F.min("did").alias("owner"))
    whole = (F.col("did") != F.col("owner")) & (F.col("n") >= kind.width)
    # Rows that repeat an id and a text give a text twice.
    by_text = lost.groupBy("cid").agg(*(F.any_value(c).alias(f"t_{c}") for c in ("n_removed", "n_spans", "sha")))
    decided = sketched.drop("keys").join(owners, "cid").join(by_text, "cid", "left").select(
        "doc_id", "did", "cid", "n",
        F.when(whole, F.col("n")).otherwise(F.coalesce("t_n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("t_n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("t_sha", "sha")).alias("sha"),
        whole.alias("copy"),
    )
    return decided, lost
