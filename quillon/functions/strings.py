"""String and n-gram columns; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an expression inside a lambda would otherwise be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of a-z of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def normalized(text: Column) -> Column:
    """Lower case, anything but letters and digits collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def shingles(tokens: Column, n: int) -> Column:
    """Distinct n-grams of tokens, joined by spaces; all tokens as one if they are fewer; none without tokens."""


    def cut(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(many)).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, cut)


def char_grams(text: Column, n: int = 4) -> Column:
    """Distinct byte n-grams of the lower-cased text, punctuation and white space collapsed to single spaces, padded by one on either side."""
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Punct}]+", " ")), F.lit(" "))

    def cut(raw: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.octet_length(raw) - (n - 1)), lambda i: F.hex(F.substring(raw, i, F.lit(n))))
        return F.when(F.octet_length(raw) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return let(flat.cast("binary"), cut)


def key_words(key: Column) -> Column:
    """Words of a key: snake, kebab, dotted, spaced, slashed, camel case, and a letter before a digit."""
    marked = F.regexp_replace(key, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\d)", "_")
    return F.filter(F.split(F.lower(marked), r"[_\-. /:]+"), lambda w: w != "")


def literal_count(text: Column, literal: Column) -> Column:
    """Occurrences of ``literal`` whose neighbours are neither letters nor digits."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(literal), F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.regexp_count(F.lower(text), quoted)


def literal_form(text: Column) -> Column:
    """A literal as it is compared: lower case, quotes and end punctuation stripped, ``_`` and ``-`` as spaces, spaces collapsed."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"""^["'`.,;\s]+|["'`.,;\s]+$""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[_-]", " "), r"\s+", " "))


def group_number(text: Column) -> Column:
    """0-99 from the text's SHA-256: equal groups always fall together."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    return let(F.size(F.array_intersect(a, b)), lambda both: F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0)))


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))
