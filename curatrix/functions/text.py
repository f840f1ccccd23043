"""Text expressions with the semantics of the catalog's wire format (JavaScript strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, as a regular expression class.
JS_SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"
SLUG_LENGTH = 120
#: What stands between search tokens.
NO_TOKEN = "[^\\p{L}\\p{N}]+"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def normalize_text(text: Column) -> Column:
    """White space runs to one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), JS_SPACE, " "))


def slugify(name: Column) -> Column:
    """Lower case, other characters to single hyphens, at most 120 characters, never empty."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, SLUG_LENGTH), F.lit("")), F.lit("artifact"))


def has_examples(text: Column) -> Column:
    """A fenced block, an examples/ path or a usage heading."""
    return F.coalesce(text.rlike("```") | text.rlike("examples/") | text.rlike("(?mi)^##\\s+usage"), F.lit(False))


def tokens(text: Column) -> Column:
    """Search tokens: lower case, accents folded, split at everything but letters and digits."""
    return F.filter(F.split(fold_accents(F.lower(F.coalesce(text, F.lit("")))), NO_TOKEN), lambda t: t != "")


def spaced_tokens(text: Column) -> Column:
    """The same tokens as a text, with single spaces between them."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(F.coalesce(text, F.lit("")))), NO_TOKEN, " "))


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks; other scripts keep theirs. Texts in ASCII are left alone."""
    call = lambda fn, x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(fn), x, F.lit(False))
    plain = F.regexp_replace(call("decompose", text), "(\\p{IsLatin})\\p{Mn}+", "$1")
    return F.when(text.isNull() | (F.octet_length(text) == F.char_length(text)), text).otherwise(call("compose", plain))
