import hashlib
import re

import pytest
from pyspark.sql import functions as F

from evalspark.functions import scores, text, vectors


def apply(spark, function, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in frame.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_equals_python(spark):
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace()]
    values = ["".join(spaces) + "a b" + "".join(reversed(spaces)), "", " ", "\n\t", "x", "a​"]
    assert apply(spark, text.strip, values) == [v.strip() for v in values]


def test_clean_text(spark):
    values = ["a\x00b\r\nc\rd\n\n\n\n\ne  f\t\tg \t h  ", "  x  ", "\r\r\r\r", None]
    want = ["ab\nc\nd\n\ne f g h", "x", "", None]
    assert apply(spark, text.clean_text, values) == want


def test_has_text_agrees_with_clean_text(spark):
    values = ["", " ", "\x00", "\x00\n \x00", "a", "\x00 b", "​", "\u0085"]
    assert apply(spark, text.has_text, values) == [c != "" for c in apply(spark, text.clean_text, values)]


def test_markdown(spark):
    values = [
        "# T\n## U  \n#no\ntext # x",
        "**b** *i* __u__ _v_ a_b_c",
        "x ```code\nmore``` y `in` z",
        "[t](u) ![](v) ![alt](w)",
        "<b>x</b>\n---\n***  \n--",
        "line # not a heading",
    ]
    want = [
        "T\nU  \n#no\ntext # x",
        "b i u v abc",
        "x  y  z",
        "t  !alt",
        "x\n\n\n--",
        "line # not a heading",
    ]
    assert apply(spark, text.strip_markdown, values) == want


def test_bytes_are_decoded(spark):
    frame = spark.createDataFrame([(bytearray(b"a\xff\xfe\r\nb\r\xc3\xa9"),)], "x binary")
    got = frame.select(text.decode_utf8(F.col("x"))).head()[0]
    assert got == b"a\xff\xfe\nb\n\xc3\xa9".decode("utf-8", errors="replace")


@pytest.mark.parametrize(
    "path,name,suffix,kind",
    [
        ("/a/b.TXT", "b.TXT", ".txt", "txt"),
        ("/a/b.tar.Md", "b.tar.Md", ".md", "md"),
        ("/a.d/noext", "noext", "", ""),
        ("/a/.hidden", ".hidden", "", ""),
    ],
)
def test_paths(spark, path, name, suffix, kind):
    assert apply(spark, text.file_name, [path]) == [name]
    assert apply(spark, text.suffix, [path]) == [suffix]
    assert apply(spark, text.file_type, [path]) == [kind]


def test_words_claims_hash_preview(spark):
    assert apply(spark, text.tokens, ["A b, b.C;  d!", ""]) == [["a", "b", "b", "c", "d"], []]
    assert apply(spark, text.claims, ["One. Two? Three!\nFour.", "  ", "v1.2 is out"]) == [
        ["One", "Two", "Three", "Four."],
        [],
        ["v1.2 is out"],
    ]
    assert apply(spark, text.text_sha, ["é😀"]) == [hashlib.sha256("é😀".encode()).hexdigest()]
    long = "a\n" * 100
    assert apply(spark, text.preview, [long]) == [long[:120].replace("\n", " ")]


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in frame.select(vectors.normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert frame.select(vectors.dot(F.col("v"), F.col("v"))).head()[0] == 25.0


def test_score_texts(spark):
    values = [0.0, 0.0625, 0.2875, 0.39999, 0.4, 0.55, 0.7, 0.85, 1.0]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    rows = frame.select("x", scores.fixed(F.col("x"), 3), scores.bar(F.col("x")), scores.band(F.col("x"))).collect()
    for x, shown, bar, band in rows:
        assert shown == f"{x:.3f}"
        assert bar == "█" * int(x * 20) + "░" * (20 - int(x * 20))
        low = [b for b in (0.85, 0.7, 0.55, 0.4) if x >= b]
        names = {0.85: "Excellent", 0.7: "Good", 0.55: "Acceptable", 0.4: "Poor"}
        assert band == (names[low[0]] if low else "Very poor")
    assert apply(spark, scores.metric_label, ["context_recall"]) == ["Context Recall"]
    assert apply(spark, scores.numeric, ["1.5", "NaN", "n/a", None]) == [1.5, None, None, None]


def test_stamp():
    from datetime import datetime

    from evalspark.sources.tables import stamp

    assert re.fullmatch(r"\d{8}_\d{6}", stamp())
    assert stamp(datetime(2024, 3, 5, 6, 7, 8)) == "20240305_060708"
