"""SimHash near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

The fingerprint of a text has ``PRINTS`` times 64 bits over its different words, which count
twice, and word pairs: texts as similar as that differ in some 7 % of the bits, others in
nearly half. It is
cut into halves of 64 bits, so few that of a similar pair one half differs by at most one
bit; each half is indexed with each bit left out, and equal keys are joined:

1. ``(key, id)`` rows of one key come sorted to one task. Up to ``RUN`` texts of a key are
   compared with each other. A longer run, a family of near copies, is not paired: its texts,
   each once or twice, get their fingerprints, and all within ``FAR`` bits are paired with the
   ``HUBS`` texts nearest to the majority of the family's bits, which is the text the others
   come from; what is left over goes on in the same way.
2. Each different pair is verified with all shingles of both texts.
3. Groups are the connected parts of the pairs that hold.
4. A long run whose texts are not of one group then is paired after all: each two of its texts
   that are of different groups, have a key in common, are within ``WIDE`` bits and can have
   enough shingles in common, in cells of bounded size. These pairs are verified too, so hubs
   only save work: the groups are those of all pairs of a key. Texts cannot have more shingles in
   common than the sum of the smaller counts of each of ``SLOTS`` parts that shingles are dealt to,
   which leaves few pairs of a family of texts with changes of their own.

Each feature (word or pair) that a similar pair does not share lies in one of the shingles that
it does not share, at most a ninth of all. So it is expected to differ in 40 of 256 bits at
most, with a deviation of 6; ``WIDE`` is nine of these beyond, and below what other texts have.

Equal texts are one text from the start. It is an index, so some similar pairs can be missed;
``tests/llm`` holds the recall against brute force. No two texts are put together without a
chain of verified pairs.

Defined cases: texts without words are alike; a text of fewer words than a shingle is one
shingle; rows without an id take no part in groups; rows that repeat an id are told apart by
their text; a text with several ids counts with the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.simhash import _BITS, _LOWER, CHUNK, SEED, components, half_variants
from evalspark.llm.words import bounded_batches, split_words, texts_of
from evalspark.session import stage

SHINGLE = 5
SIMILARITY = 0.8
PRINTS = 4
RUN = 16
# Bits of the whole fingerprint by which members of a family differ from its middle at most.
FAR = 48
HUBS = 4
# Bits of the whole fingerprint by which a similar pair differs at most.
WIDE = 96
# Texts of a long run that meet in one cell, on each of its two sides.
CELL = 4096
# Parts that shingles are dealt to, to tell how many two texts have in common at most.
SLOTS = 256
WORDS_KEPT = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread numbers, one for each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Numbers of the words of a text, with those of frequent words remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, data: bytes) -> np.ndarray:
        words, known = split_words(data.translate(_LOWER)), self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The different numbers of ``size`` words in a row; of fewer words, that of all."""
    size = min(size, len(words))
    found = np.zeros(max(len(words) - size + 1, 0) if size else 1, np.uint64)
    for i in range(size):
        found = mixed(found + words[i : len(words) - size + 1 + i] + _ODD)
    return np.unique(found)


def prints(words: np.ndarray, count: int) -> np.ndarray:
    """The fingerprint as ``count`` integers: a bit is 1 if set in over half, words counting twice."""
    parts = [(shingles(words, 1), 2), (shingles(words, 2), 1)]
    half = sum(weight * len(part) for part, weight in parts)
    out = np.empty(count, np.int64)
    for i in range(count):
        ones = np.zeros(64, np.int64)
        for part, weight in parts:
            data = mixed(part + _ODD * np.array([i + 1], np.uint64)).view(np.uint8).reshape(-1, 8)
            ones += weight * np.concatenate([np.bincount(data[:, k], minlength=256) @ _BITS for k in range(8)])
        out[i] = np.packbits(2 * ones > half, bitorder="little").view(np.int64)[0]
    return out


def text_id() -> tuple[Column, Column]:
    """``(id, sha)`` of a text: a short one for the index, and one that tells texts apart."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha")


def with_prints(docs: DataFrame, count: int) -> DataFrame:
    """``doc_id, id, sha, print`` for each row of ``docs``."""
    names = ["doc_id", "id", "sha"]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in found:
            made = [prints(hasher.words(data), count) for data in texts_of(batch, "text")]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(made) if made else np.zeros(0, np.int64)), count)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), flat.cast(pa.list_(pa.int64()))], names=[*names, "print"])

    return docs.select("doc_id", *text_id(), "text").mapInArrow(
        batches, "doc_id bigint, id bigint, sha binary, print array<bigint>"
    )


def with_shingles(texts: DataFrame, size: int) -> DataFrame:
    """``id, sha, shingles`` of each row."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in found:
            made = [shingles(hasher.words(data), size).view(np.int64) for data in texts_of(batch, "text")]
            ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made) if made else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sha"), column], names=["id", "sha", "shingles"])

    return texts.select("id", "sha", "text").mapInArrow(batches, "id bigint, sha binary, shingles array<bigint>")


def runs(batches: Iterator[pa.RecordBatch], names: list[str], chunk: int | None = None) -> Iterator[list[np.ndarray]]:
    """Whole runs of equal keys (the first column) of sorted rows, many at a time. A run beyond ``chunk``
    (``CHUNK``) rows comes in parts, each after the first with ``HUBS`` rows of the one before."""
    held: list[np.ndarray] | None = None
    chunk = chunk or CHUNK
    for batch in batches:
        new = [as_numbers(batch.column(n)) for n in names]
        held = new if held is None else [np.concatenate((h, c)) for h, c in zip(held, new)]
        if len(held[0]) < chunk:
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
        else:
            yield held
            held = [c[-HUBS:] for c in held]
    if held is not None and len(held[0]):
        yield held


def as_numbers(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def by_key(rows: DataFrame, scan: Callable, columns: str) -> DataFrame:
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, "key").sortWithinPartitions("key", "id").mapInArrow(scan, columns)


def candidates(texts: DataFrame, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """``a < b``: ids of texts that one half of the fingerprint brings together, in long runs with hubs
    only; and ``key, id`` of the long runs, for ``rest``, with the smallest id of a run as its key."""
    spark = texts.sparkSession

    def variants(batches):
        for batch in batches:
            ids, whole = as_numbers(batch.column("id")), as_numbers(batch.column("print"))
            for i in range(whole.shape[1] if len(ids) else 0):
                for at in range(0, len(ids), 2048):
                    key = half_variants(np.ascontiguousarray(whole[at : at + 2048, i])) | np.int64(i << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ids[at : at + 2048], key.shape[1]))], names=["key", "id"])

    names = ["key", "low", "a", "b", "over"]

    def told(keys, low, a, b, over: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, (keys, low, a, b)), pa.array(np.full(len(a), over))], names=names)

    def paired(batches):
        before, least = None, 0
        for keys, ids in runs(batches, ["key", "id"]):
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(first, len(keys)))
            # The last part of a run that comes in parts may be short.
            long = np.repeat((size > run) | (keys[first] == before), size)
            # Rows of a run are in order of their ids: its smallest and its largest name it.
            low, high = np.repeat(np.where(keys[first] == before, least, ids[first]), size), np.repeat(ids[first + size - 1], size)
            before, least = keys[-1], low[-1]
            if long.any():
                yield told(keys[long], low[long], ids[long], high[long], True)
                keys, ids = keys[~long], ids[~long]
            met = []
            for lag in range(1, min(run, size.max(initial=1))):
                i = np.flatnonzero(keys[lag:] == keys[:-lag])
                met.append(np.stack((ids[i], ids[i + lag]), 1))
            if met:
                pair = np.unique(np.concatenate(met), axis=0)
                pair = pair[pair[:, 0] < pair[:, 1]]
                yield told(pair[:, 0], pair[:, 0], pair[:, 0], pair[:, 1], False)

    def starred(batches):
        for keys, ids, whole in runs(batches, ["key", "id", "print"]):
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            met = [star(i, w) for i, w in zip(np.split(ids, cuts), np.split(whole, cuts))]
            pair = np.unique(np.concatenate(met), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    keyed = texts.select("id", "print").mapInArrow(variants, "key bigint, id bigint")
    found = stage(by_key(keyed, paired, "key bigint, low bigint, a bigint, b bigint, over boolean"), spark)
    # A text is in many runs of its family; it is taken once by the smallest and once by the
    # largest id that it met there, which all of the family have in common but for few.
    over = found.filter("over")
    long = over.groupBy(F.col("a").alias("id")).agg(F.min("low").alias("low"), F.max("b").alias("high"))
    families = long.join(texts.select("id", "print"), "id").select(F.explode(F.array("low", "high")).alias("key"), "id", "print")
    stars = by_key(families, starred, "a bigint, b bigint")
    pairs = found.filter("NOT over").select("a", "b").unionByName(stars).distinct()
    return pairs, over.select(F.col("low").alias("key"), F.col("a").alias("id")).distinct()


def with_slots(cut: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``sha, slots``: how many shingles of each text fall into each slot."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            column = batch.column("shingles")
            size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            slot = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(slots)
            at = np.repeat(np.arange(len(size)) * slots, size) + slot.astype(np.int64)
            flat = pa.array(np.bincount(at, minlength=len(size) * slots).astype(np.int32))
            counts = pa.FixedSizeListArray.from_arrays(flat, slots).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("sha"), counts], names=["sha", "slots"])

    return cut.select("sha", "shingles").mapInArrow(batches, "sha binary, slots array<int>")


def rest(over: DataFrame, texts: DataFrame, root: DataFrame, cut: DataFrame, similarity: float, cell: int = CELL) -> DataFrame:
    """``a < b``: ids of the texts of a long run that are in different groups by ``root(node, root)``
    and not too far apart to be similar.

    Runs of one group drop out as rows ``key, id``. The texts of the others fall into parts of some
    ``cell`` texts, and each two parts meet in a cell of their own.
    """
    spark = over.sparkSession
    long = cut.join(over.select("id").distinct(), "id", "left_semi")
    member = texts.join(root, F.col("sha") == root["node"], "left").select(
        "id", "sha", "print", F.xxhash64(F.coalesce("root", "sha")).alias("of")
    )
    member = stage(member.join(with_slots(long), "sha").drop("sha"), spark)
    rows = stage(over.join(member.select("id", "of"), "id"), spark)
    mixed = rows.groupBy("key").agg(F.min("of").alias("one"), F.max("of").alias("two"), F.count("*").alias("n")).filter("one <> two")
    mixed = mixed.select("key", F.ceil(F.col("n") / cell).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    met = rows.join(mixed, "key").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first, second = F.least("part", "other"), F.greatest("part", "other")
    # Within a part all meet (2), of two parts only one the other (0, 1).
    side = F.when(first == second, 2).otherwise((F.col("part") == second).cast("int")).cast("bigint")
    cells = met.select(F.xxhash64("key", first, second).alias("key"), "id", "of", side.alias("side")).join(
        member.select("id", "print", "slots").dropDuplicates(["id"]), "id"
    )
    names = ["id", "of", "side", "print", "slots"]
    # Cells hold some 2 * cell rows of a kilobyte and more.
    chunk = 4 * max(cell, CELL)

    def across(batches):
        for keys, *columns in runs(batches, ["key", *names], chunk):
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            met = [strangers(*c, similarity) for c in zip(*(np.split(column, cuts) for column in columns))]
            pair = np.unique(np.concatenate(met), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return by_key(cells.select("key", *names), across, "a bigint, b bigint").distinct()


def strangers(
    ids: np.ndarray, of: np.ndarray, side: np.ndarray, whole: np.ndarray, slots: np.ndarray, similarity: float
) -> np.ndarray:
    """Pairs of a cell's texts of different groups that have a key in common, are within ``WIDE`` bits
    and can be similar by the counts of their shingles."""
    n = slots.sum(1, dtype=np.int64)
    groups, of, size = np.unique(of, return_inverse=True, return_counts=True)
    pairs = [np.zeros((0, 2), np.int64)]
    # All pairs have one text that is not of the largest group.
    small = of != np.argmax(size)
    for i in np.flatnonzero(small):
        allowed = (of != of[i]) & ((side != side[i]) | (side == 2))
        j = np.flatnonzero(allowed)
        j = j[(apart(whole[j], whole[i]) <= WIDE) & meet(whole[j], whole[i])]
        common = np.minimum(slots[j], slots[i]).sum(1, dtype=np.int64)
        j = j[common >= similarity * (n[j] + n[i] - common)]
        pairs.append(np.stack((np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])), 1))
    return np.unique(np.concatenate(pairs), axis=0)


def star(ids: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Pairs of a run's texts with those nearest to the majority of their neighbourhood's bits."""
    pairs = [np.zeros((0, 2), np.int64)]
    while len(ids) > 1:
        bits = np.unpackbits(np.ascontiguousarray(whole).view(np.uint8), axis=1)
        middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(ids)).view(np.int64)
        from_middle = apart(whole, middle)
        hub = int(np.argmin(from_middle))
        near = apart(whole, whole[hub]) <= FAR
        members = np.flatnonzero(near)
        hubs = members[np.lexsort((ids[members], from_middle[members]))[:HUBS]]
        for h in hubs:
            pairs.append(np.stack((np.minimum(ids[members], ids[h]), np.maximum(ids[members], ids[h])), 1))
        ids, whole = ids[~near], whole[~near]
    found = np.concatenate(pairs)
    return found[found[:, 0] < found[:, 1]]


def apart(whole: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count((whole ^ one).view(np.uint64)).sum(1, dtype=np.int64)


def meet(whole: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Do prints have a key in common: a half in which they differ by at most one bit?"""
    return (np.bitwise_count((whole ^ one).view(np.uint32)) <= 1).any(1)


def cut_texts(docs: DataFrame, pairs: DataFrame, over: DataFrame, shingle: int) -> DataFrame:
    """``id, sha, shingles`` of each different text that is in a pair or a long run."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(over.select("id")).distinct()
    # Equal texts have one id, so they are in one place when they have met it.
    texts = docs.select(*text_id(), "text").join(wanted, "id", "left_semi").dropDuplicates(["id", "sha"])
    return with_shingles(texts, shingle)


def verified(cut: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: the texts (``sha``) of pairs of ids that are similar enough."""
    one, two = (cut.select(F.col("id").alias(n), F.col("sha").alias(f"{n}_sha"), F.col("shingles").alias(f"{n}_s")) for n in "ab")
    # A family's hub meets many: the others' shingles move to it, and only the verdict goes on.
    common = F.size(F.array_intersect("a_s", "b_s"))
    either = F.size("a_s") + F.size("b_s") - common
    return pairs.join(one, "a").join(two, "b").filter(common >= F.lit(similarity) * either).select(
        F.col("a_sha").alias("a"), F.col("b_sha").alias("b")
    )


def similar_groups(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, count: int = PRINTS, run: int = RUN
) -> DataFrame:
    """``doc_id, sha, root``: the group of each different ``(doc_id, text)`` of the rows that have an
    id, and with ``stands`` the one that stands for it: the smallest id, of its texts the smallest."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.filter("doc_id IS NOT NULL")
    made = stage(with_prints(docs, count), spark)
    texts = made.groupBy("sha").agg(F.any_value("id").alias("id"), F.any_value("print").alias("print"))
    texts = stage(texts, spark)
    pairs, over = candidates(texts, run)
    pairs, over = stage(pairs, spark), stage(over, spark)
    cut = stage(cut_texts(docs, pairs, over, shingle), spark)
    edges = stage(verified(cut, pairs, similarity).distinct(), spark)
    root = components(edges)
    more = stage(rest(over, texts, stage(root, spark), cut, similarity), spark)
    if not more.isEmpty():
        edges = edges.unionByName(verified(cut, more, similarity).distinct())
        root = components(stage(edges, spark))
    placed = made.select("doc_id", "sha").distinct().join(root, F.col("sha") == root["node"], "left").select(
        "doc_id", "sha", F.coalesce("root", "sha").alias("root")
    )
    placed = stage(placed, spark)
    first = placed.groupBy("root").agg(F.min(F.struct("doc_id", "sha")).alias("first"))
    return placed.join(first, "root").select(
        "doc_id", "sha", "root", F.col("first.doc_id").alias("component_id"), (F.col("first") == F.struct("doc_id", "sha")).alias("stands")
    )


def one_of_each_group(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, count: int = PRINTS, run: int = RUN
) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies; of rows that repeat an id
    and text one stays. Rows without an id stay. All columns are carried, whatever their names."""
    groups = similar_groups(docs, shingle, similarity, count, run).filter("stands").select(
        F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")
    )
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), text_id()[1])
    kept = packed.join(groups, (packed["id"] == groups["_id"]) & (packed["sha"] == groups["_sha"])).select("row", "id", "sha")
    # Only rows that repeat an id and text are gathered once more.
    often = stage(kept.groupBy("id", "sha").agg(F.count("*").alias("n")).filter("n > 1"), docs.sparkSession)
    single = kept.join(often, ["id", "sha"], "left_anti").select("row")
    again = kept.join(often, ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"]).select("row")
    return single.unionByName(again).unionByName(packed.filter("id IS NULL").select("row")).select("row.*")
