"""Folders of text files to a document table, with the files left out and why."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions import text as tx
from evalspark.operators.chunking import chunk_offsets
from evalspark.sources.hidden import HiddenFiles

# The suffixes of a corpus.
SUPPORTED = (".txt", ".md", ".markdown", ".pdf")
# Suffix to a column function from bytes to text. A PDF reader is the user's to add:
# it is a codec that works on one file at a time.
LOADERS: dict[str, Callable[[Column], Column]] = {
    ".txt": tx.decode_utf8,
    ".md": lambda content: tx.strip_markdown(tx.decode_utf8(content)),
    ".markdown": lambda content: tx.strip_markdown(tx.decode_utf8(content)),
}


def document_metadata(path: Column, text: Column) -> dict[str, Column]:
    return {
        "source": path,
        "filename": tx.file_name(path),
        "file_type": tx.file_type(path),
        "char_count": F.char_length(text),
    }


def any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def scan_files(spark: SparkSession, directory: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """Files under ``directory``, with ``suffixes`` only those that end so in any case.

    A folder that does not exist is an error.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    if suffixes:
        scan = scan.option("pathGlobFilter", f"*{{{','.join(map(any_case, suffixes))}}}")
    try:
        return (
            scan.load(directory)
            .select("path", "length", "content")
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such folder of documents: {directory}") from error
        raise


def hidden_files(spark: SparkSession, directory: str, suffixes: Sequence[str], limit: int) -> DataFrame:
    """``path, length, content`` of the files that Spark's listing leaves out; content for ``suffixes`` only."""
    spark.dataSource.register(HiddenFiles)
    return (
        spark.read.format(HiddenFiles.name())
        .option("path", directory)
        .option("suffixes", ",".join(suffixes))
        .option("limit", limit)
        .load()
    )


def number_by_path(table: DataFrame) -> DataFrame:
    """``doc_id`` from 0 by path, compared part by part."""
    parts = table.select(F.lit("").alias("experiment"), F.split("source", "/").alias("parts"))
    numbers = chunk_offsets(parts, "parts").select("parts", F.col("first_index").alias("doc_id"))
    return (
        table.withColumn("parts", F.split("source", "/"))
        .join(numbers, "parts")
        .select("doc_id", *table.columns)
    )


def load_files(
    spark: SparkSession, directory: str, loaders: dict[str, Callable[[Column], Column]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(documents, rejects)``.

    Documents are ``doc_id, text, source, filename, file_type, char_count``, and
    rejects ``path, reason``: unsupported, no loader, too large (for one value), unreadable
    or empty. Files with hidden names are treated as all others.
    """
    loaders = loaders or LOADERS
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    files = scan_files(spark, directory).unionByName(hidden_files(spark, directory, [], 0)).withColumn("suffix", tx.suffix(F.col("path")))
    # Bytes of other files are never read, so their size does not matter.
    hidden = hidden_files(spark, directory, list(loaders), limit)
    wanted = scan_files(spark, directory, list(loaders)).unionByName(hidden).withColumn("suffix", tx.suffix(F.col("path")))
    wanted = wanted.filter(F.col("suffix").isin(*loaders) & (F.col("length") <= limit))
    loaded = F.when(F.lit(False), "")
    for suffix, load in loaders.items():
        loaded = loaded.when(F.col("suffix") == suffix, load(F.col("content")))
    read = wanted.select("path", loaded.alias("text"))
    full = read.filter(tx.has_text(F.col("text"))).withColumn("text", tx.clean_text(F.col("text")))
    documents = number_by_path(
        full.select("text", *[c.alias(n) for n, c in document_metadata(F.col("path"), F.col("text")).items()])
    )
    # The content column is not read for files that no loader takes.
    unread = files.filter(~F.col("suffix").isin(*loaders)).select(
        "path",
        F.when(F.col("suffix").isin(*SUPPORTED), "no loader").otherwise("unsupported").alias("reason"),
    )
    # A file that cannot be read leaves no row in ``read``; its listing does.
    states = read.select("path", F.when(tx.has_text(F.col("text")), "full").when(F.col("text").isNotNull(), "empty").alias("state"))
    listed = files.filter(F.col("suffix").isin(*loaders)).select("path", "length").join(states, "path", "left")
    failed = listed.filter("state IS NULL OR state != 'full'").select(
        "path", F.when(F.col("length") > limit, "too large").otherwise(F.coalesce("state", F.lit("unreadable"))).alias("reason")
    )
    return documents, unread.unionByName(failed)


def assemble_pages(pages: DataFrame, document: str, number: str, text: str = "text") -> DataFrame:
    """One text per document: its pages in order, empty ones dropped, a blank line between.

    The pages of a document become one value, so they fit a task as that value does.
    """
    pages = pages.filter(F.coalesce(F.col(text), F.lit("")) != "")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(number), F.col(text))))
    return pages.groupBy(document).agg(ordered.alias("p")).select(
        document,
        F.array_join(F.col(f"p.{text}"), "\n\n").alias("text"),
        F.size("p").alias("n_pages"),
    )
