"""Text functions as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STOP_TOKENS

#: All white space, as a regular expression class for both Java and RE2.
SPACE = r"[\s\x0b\x{85}\p{Z}]"


def trim_space(c: Column) -> Column:
    """The text without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def ascii_fold(c: Column) -> Column:
    """A-Z made small, all else kept: the folding of a case-insensitive LIKE over ASCII."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def like_ascii(c: Column, query: str) -> Column:
    """Whether the text holds the query, ASCII letters alike; ``%`` and ``_`` in the query are wildcards."""
    folded = query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return F.like(ascii_fold(c), F.lit(f"%{folded}%"), F.lit("\u0001"))


def lines_of(c: Column) -> Column:
    """The lines of a text: any line end, and no empty line after the last one."""
    parts = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def rank_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, of two or more, without stop words; repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 2) & ~t.isin(STOP_TOKENS))


def overlap_ratio(query_tokens: Column, tokens: Column) -> Column:
    """Share of the distinct query tokens that are among ``tokens``; 0 if either is empty."""
    asked = F.array_distinct(query_tokens)
    return F.when((F.size(asked) > 0) & (F.size(tokens) > 0), F.size(F.array_intersect(asked, tokens)) / F.size(asked)).otherwise(F.lit(0.0))


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def compact_preview(c: Column) -> Column:
    """One line without runs of white space; of more than 160 bytes the first 157 characters and dots."""
    flat = F.regexp_replace(trim_space(c), f"{SPACE}+", " ")
    return F.when(F.octet_length(flat) > 160, F.concat(F.substring(flat, 1, 157), F.lit("..."))).otherwise(flat)


def normalized_name(c: Column) -> Column:
    """A project name: letters and digits made small, ``-_.`` kept, all else ``-``; ``default`` if nothing is left."""
    kept = F.regexp_replace(F.lower(trim_space(c)), r"[^\p{L}\p{Nd}_.-]", "-")
    bare = F.regexp_replace(kept, "^[-.]+|[-.]+$", "")
    return F.when(bare == "", F.lit("default")).otherwise(bare)


def result_reason(mode: Column, category: Column, content: Column, path: Column) -> Column:
    """Why a result is shown."""
    base = base_name(path)
    extension = F.when(base.contains("."), F.concat(F.lit("."), F.substring_index(base, ".", -1))).otherwise(F.lit(""))
    low = F.lower(base)
    stem = F.when((extension != "") & low.endswith(extension), F.substring(low, F.lit(1), F.length(low) - F.length(extension))).otherwise(low)
    parts = F.concat_ws(
        "; ",
        F.when(mode.contains("semantic"), "strong semantic match"),
        F.when(category == "source", "actionable source code"),
        F.when(F.contains(F.lower(content), stem), "file content aligns with file name"),
    )
    return F.when(parts == "", F.lit("relevant ranked match")).otherwise(parts)
