"""Benchmark decontamination: documents are streamed through a suffix automaton of the items.

The items are the stated query set; they are cut into pieces that share no window and dealt
into blocks of at most ``BLOCK_WORDS`` words or so. Each block is gathered on the driver
(its size was counted before), built into an automaton and broadcast; every document meets
every block in a scan, without a shuffle. With several blocks, their hits meet by document.

Defined cases: null and empty texts have no words; items without words are no items, and
items that share a window each count; a null ``item_id`` is listed as an empty string; rows
that repeat an id are judged one by one; other columns, whatever their names, are carried.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.automaton import ItemAutomaton
from evalspark.llm.words import bounded_batches, carrying, in_slices, texts_of
from evalspark.session import stage

WIDTH = 10
BLOCK_WORDS = 200_000
PIECE_WORDS = 20_000
# A document goes as a whole when more than this part of its words is leaked.
MAX_COVERAGE = 0.5

# Words are 0-9, a-z (after A-Z are lowered) and all that is not ASCII.
_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def item_words(data: bytes) -> list[bytes]:
    return data.translate(_KEEP).split()


def pieces(items: DataFrame, width: int) -> DataFrame:
    """``item, piece, n, body``: words of each item, long items cut without losing a window."""
    schema = pa.schema([("item", pa.string()), ("piece", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])

    def rows(batches):
        for batch in batches:
            for item, data in zip(batch.column("item").to_pylist(), texts_of(batch, "text")):
                words = item_words(data)
                for at in range(0, max(len(words) - width + 1, min(len(words), 1)), PIECE_WORDS):
                    part = words[at : at + PIECE_WORDS + width - 1]
                    yield item or "", at, len(part), b" ".join(part)

    return items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(
        lambda b: in_slices(rows(b), schema, 3), "item string, piece bigint, n bigint, body binary"
    )


def scan(docs: DataFrame, block: list[tuple[str, bytes]], width: int, emit: Callable, schema: T.StructType) -> DataFrame:
    """``emit(words, spans, items)`` of each document against one block, after its own columns.

    ``spans`` are the hit stretches, merged, as ``[begin, end)`` word numbers.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(ItemAutomaton([(i, b.split()) for i, b in block], width))
    out = T.StructType([*docs.schema.fields, *schema.fields])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton.value
        for whole in found:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                told = []
                for data in texts_of(batch, "text"):
                    words = item_words(data)
                    spans: list[list[int]] = []
                    states = set()
                    for begin, end, state in machine.hits(words):
                        states.add(state)
                        while spans and begin <= spans[-1][0]:
                            end = max(end, spans.pop()[1])
                        if spans and begin <= spans[-1][1]:
                            spans[-1][1] = max(end, spans[-1][1])
                        else:
                            spans.append([begin, end])
                    items = set().union(*(machine.items[s] for s in states)) if states else set()
                    told.append(emit(words, spans, items))
                made = [pa.array(x, to_arrow(f.dataType)) for x, f in zip(zip(*told), schema.fields)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *schema.names])

    return docs.mapInArrow(batches, out)


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    return {T.LongType: pa.int64(), T.StringType: pa.string(), T.IntegerType: pa.int32()}[type(kind)]


HITS = T.StructType(
    [
        T.StructField("_n", T.LongType()),
        T.StructField("_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("_items", T.ArrayType(T.StringType())),
    ]
)


def blocks(items: DataFrame, width: int, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Blocks of item pieces; how many words each can hold is known before it is gathered."""
    cut = stage(pieces(items, width), items.sparkSession)
    total = cut.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // block_words))
    for k in range(count):
        mine = cut.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(count)) == k)
        yield [(r.item, bytes(r.body)) for r in mine.select("item", "body").toLocalIterator()]


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``_n`` words, ``_spans`` hit and ``_items`` found, one row per row."""
    bounded_batches(docs.sparkSession)
    parts = list(blocks(items, width, block_words))
    told = lambda words, spans, found: (len(words), spans, sorted(found))
    if len(parts) == 1:
        return scan(docs, parts[0], width, told, HITS)
    keyed = stage(docs.withColumn("_row", F.expr("uuid()")), docs.sparkSession)
    each = [scan(keyed.select("_row", "text"), part, width, told, HITS).drop("text") for part in parts]
    every = functools.reduce(DataFrame.unionByName, each)
    met = every.groupBy("_row").agg(
        F.max("_n").alias("_n"),
        F.flatten(F.collect_list("_spans")).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"),
    )
    return keyed.join(met.withColumn("_spans", merged(F.col("_spans"))), "_row").drop("_row")


def merged(spans: Column) -> Column:
    """Sorted spans without overlaps."""
    none = F.array().cast("array<array<int>>")

    def add(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        joined = F.array(last[0], F.greatest(last[1], x[1]))
        return F.when((F.size(kept) > 0) & (x[0] <= F.coalesce(F.try_element_at(kept, F.lit(-1))[1], F.lit(-1))),
                      F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(joined))
                      ).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, add)


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``."""
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return hits(docs.select("doc_id", "text"), items, width, block_words).select(
        "doc_id",
        F.col("_n").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORD = (
    rb"[0-9A-Za-z\x80-\xff]+"
)


@carrying("text", "n_chars")
def cut_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the leaked stretches of ``text``; leaked for over ``max_coverage``, a row goes.

    All columns stay; ``n_chars``, where there is one, is counted anew for changed rows.
    """
    found = hits(docs, items, width, block_words)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    left = found.filter(n_hit <= F.lit(max_coverage) * F.greatest(F.col("_n"), F.lit(1)))
    schema = T.StructType([*docs.schema.fields, *HITS.fields[1:2]])
    text_at = docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def batches(found):
        import re

        word = re.compile(_WORD)
        for batch in found:
            columns = [batch.column(i) for i in range(len(docs_columns))]
            texts, spans = batch.column(text_at).to_pylist(), batch.column("_spans").to_pylist()
            counts = columns[count_at].to_pylist() if count_at is not None else None
            for i, (text, cuts) in enumerate(zip(texts, spans)):
                if cuts:
                    data = text.encode()
                    at = [m.span() for m in word.finditer(data)]
                    out, end = [], 0
                    for a, b in cuts:
                        out.append(data[end : at[a][0]])
                        end = at[b - 1][1]
                    texts[i] = (b"".join(out) + data[end:]).decode()
                    if counts is not None:
                        counts[i] = len(texts[i])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if counts is not None:
                columns[count_at] = pa.array(counts, columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = docs.columns
    return left.select(*docs_columns, "_spans").mapInArrow(batches, docs.schema)
