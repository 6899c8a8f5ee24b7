"""Text expressions. Each function maps a string column to a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped,
# written as the inside of a regex class.
WHITE_SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
# The markup rules in the order in which they apply.
# (?md) makes ^ and $ match at \n only; plain (?m) also breaks at U+2028.
MARKDOWN_RULES = (
    ("heading", rf"(?md)^#{{1,6}}[{WHITE_SPACE}]+", ""),
    ("asterisks", r"\*{1,2}([^*\n]+)\*{1,2}", "$1"),
    ("underscores", r"_{1,2}([^_\n]+)_{1,2}", "$1"),
    ("fenced code", r"```[\s\S]*?```", ""),
    ("inline code", r"`[^`\n]+`", ""),
    ("link", r"\[([^\]]+)\]\([^)]+\)", "$1"),
    ("image", r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    ("html tag", r"<[^>]+>", ""),
    ("horizontal rule", rf"(?md)^[-*_]{{3,}}[{WHITE_SPACE}]*$", ""),
)
TOKEN_BREAK = r"[\s.,;:!?]+"
CLAIM_BREAK = r"[.!?]+\s+|\n+"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends; ``trim`` removes blanks only."""
    return F.regexp_replace(text, rf"\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z", "")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def may_be_dirty(text: Column) -> Column:
    """Whether ``clean_text`` may change a text; a search for fixed strings, far cheaper than its patterns."""
    inside = [F.contains(text, F.lit(part)) for part in ("\x00", "\r", "\n\n\n", "  ", "\t")]
    ends = [end.rlike(f"[{WHITE_SPACE}]") for end in (F.left(text, F.lit(1)), F.right(text, F.lit(1)))]
    return reduce(lambda a, b: a | b, [*inside, *ends])


def clean_text(text: Column) -> Column:
    """NUL out, line ends to LF, blank lines and blanks collapsed, ends stripped."""
    return F.when(may_be_dirty(text), _cleaned(text)).otherwise(text)


def _cleaned(text: Column) -> Column:
    text = F.replace(text, F.lit("\x00"), F.lit(""))
    text = unix_newlines(text)
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return strip(text)


def has_text(text: Column) -> Column:
    """Whether anything is left of a text after ``clean_text``, without cleaning it."""
    return text.rlike(rf"[^\x00{WHITE_SPACE}]")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def strip_markdown(text: Column) -> Column:
    for _, pattern, replacement in MARKDOWN_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def decode_utf8(content: Column) -> Column:
    """Bytes to text; bytes that are not UTF-8 become U+FFFD."""
    return unix_newlines(F.make_valid_utf8(content.cast("string")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty when the name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)[^.].*?(\.[^.]+)\z", 1))


def file_type(path: Column) -> Column:
    return F.ltrim(suffix(path), F.lit("."))


def text_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def tokens(text: Column) -> Column:
    """Lower-cased words in text order."""
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def claims(text: Column) -> Column:
    """Sentences, one claim each, stripped and without empty ones."""
    return F.array_remove(F.transform(F.split(text, CLAIM_BREAK), strip), "")


def preview(text: Column, length: int = 120) -> Column:
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))


def token_share(part: Column, whole: Column) -> Column:
    """Share of the tokens in ``part`` that occur in ``whole`` (token sets)."""
    return F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0))
