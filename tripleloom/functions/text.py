"""Scalar text functions: normalisation, compounds, identifiers, rendering."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keys whose names mark the origin of a record (fixed values).
PROVENANCE = ["source_", "sample_id", "doc_id", "document_id", "chunk_id", "essay_id"]


#: What the JVM's lower case and white space can't be trusted with: all but ASCII, and the separators U+001C to U+001F.
_BEYOND_ASCII = r"[^\x00-\x1B\x20-\x7F]"


def plain_label(label: str) -> str:
    """``normalize_label`` of one string."""
    return " ".join(unicodedata.normalize("NFKC", label).lower().split())


@F.pandas_udf(StringType())
def unicode_label(labels: pd.Series) -> pd.Series:
    """NFKC, lower case, white space collapsed; Spark has no compatibility composition of its own."""
    # Nearly all batches hold nulls only: their labels are ASCII.
    return labels if labels.isna().all() else labels.map(lambda s: None if s is None else plain_label(s))


def collapse(label: Column) -> Column:
    """Lower case, white space runs to one space, trimmed; null becomes empty."""
    # Single spaces, by far the most of all, are left alone.
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[\t-\r]\s*| \s+", " "))


def beyond_ascii(label: Column) -> Column:
    """Whether ``normalize_label`` is more than ``collapse`` for a label."""
    return label.rlike(_BEYOND_ASCII)


def normalize_label(label: Column, unicode: bool = True) -> Column:
    """Canonical surface form of a label: NFKC, lower case, white space collapsed.

    ASCII labels, which NFKC leaves as they are, stay in the JVM. With
    ``unicode=False`` all labels do.
    """
    if not unicode:
        return collapse(label)
    return F.coalesce(unicode_label(F.when(label.rlike(_BEYOND_ASCII), label)), collapse(label))


#: What Python's strip() takes off: Unicode separators, tabs and line ends, and the separators U+001C to U+001F.
_BLANK = "".join(map(chr, [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def clean(text: Column) -> Column:
    """Trim white space of any kind; null becomes empty.

    Only texts with a character of ``_BLANK`` at an end are trimmed: nearly
    all others are told by two looks at their ends.
    """
    text = F.coalesce(text, F.lit(""))
    plain = (text >= "!") & (text < "\x7f") & F.right(text, F.lit(1)).between("!", "~")
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(_BLANK)))


def compound(name: Column, type_label: Column) -> Column:
    return F.concat(name, F.lit(" ["), type_label, F.lit("]"))


_COMPOUND = r"(?s)^(.+?)\s*\[(.+?)\]$"


def compound_name(label: Column) -> Column:
    return F.when(label.rlike(_COMPOUND), F.trim(F.regexp_extract(label, _COMPOUND, 1))).otherwise(F.trim(label))


def compound_type(label: Column) -> Column:
    return F.when(label.rlike(_COMPOUND), F.trim(F.regexp_extract(label, _COMPOUND, 2))).otherwise(F.lit(""))


#: ``_COMPOUND`` as the JVM reads it: white space is ASCII, and a last line end may follow.
_COMPOUND_ASCII = re.compile("^(.+?)\\s*\\[(.+?)\\](?=(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z)", re.S | re.A)


def plain_compound(label: str) -> str:
    """``normalize_compound`` of one string."""
    found = _COMPOUND_ASCII.match(label)
    if not found:
        return plain_label(label)
    name, kind = plain_label(found[1].strip(" ")), plain_label(found[2].strip(" "))
    return f"{name} [{kind}]" if kind else name


@F.pandas_udf(StringType())
def unicode_compound(labels: pd.Series) -> pd.Series:
    return labels.map(lambda s: "" if s is None else plain_compound(s))


def normalize_compound(label: Column, unicode: bool = True) -> Column:
    """Both halves normalised on their own; bare without a type.

    In the JVM a name and a type would be taken apart several times for each
    label, by code too long for it to compile; one call does it all.
    """
    if unicode:
        return unicode_compound(label)
    name, kind = normalize_label(compound_name(label), unicode), normalize_label(compound_type(label), unicode)
    return F.when(kind == "", name).otherwise(compound(name, kind))


def item_id(prefix: str, width: int, index: Column) -> Column:
    return F.format_string(f"{prefix}_%0{width}d", index)


def qa_normalize(text: Column) -> Column:
    """Answer normal form: lower, digit separators out, punctuation to space, collapsed.

    Letters of Latin script lose their accents and ligatures first; ASCII texts
    stay in the JVM.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.coalesce(strip_accents(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    bare = F.regexp_replace(F.lower(plain), r"(?<=\d)[,.](?=\d)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


#: Latin letters that no decomposition takes apart (fixed values).
_LATIN = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i"})


@F.pandas_udf(StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    def strip(s: str | None) -> str | None:
        return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.translate(_LATIN)) if not unicodedata.combining(c))

    return texts.map(strip)


def chunk_id(*parts: Column) -> Column:
    return F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def render_candidate(label: Column, context: Column) -> Column:
    with_context = F.concat(label, F.lit(" (context: "), context, F.lit(")"))
    return F.when(F.coalesce(context, F.lit("")) == "", label).otherwise(with_context)


def node_context(definition: Column, examples: Column, subclasses: Column) -> Column:
    """Join what is known of a node; examples and subclasses are arrays."""

    def listed(head: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(head), F.array_join(values, ", ")))

    return F.concat_ws("; ", F.when(F.coalesce(definition, F.lit("")) != "", definition), listed("for example: ", examples), listed("known subclasses: ", subclasses))


def provenance_columns(names: list[str]) -> list[str]:
    return [n for n in names if any(k in n for k in PROVENANCE)]


def loose_json(text: str | None):
    """The JSON in a model's answer: all of it, a fenced block, or from the first bracket on; else the text."""
    if text is None:
        return None
    tries = [text]
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    if fence:
        tries.append(fence[1])
    for candidate in tries:
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    opening = re.search(r"[\[{]", text)
    if opening:
        try:
            return json.JSONDecoder().raw_decode(text[opening.start() :])[0]
        except ValueError:
            pass
    return text


@F.pandas_udf(StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    """Canonical JSON of ``loose_json``; plain text comes back as a JSON string."""
    return texts.map(lambda s: None if s is None else json.dumps(loose_json(s), sort_keys=True, ensure_ascii=False))
