"""The text that is embedded for a chunk: its place, role and purpose before its code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from .classify import category_of
from .text import base_name, trim_space


def is_boundary(line: Column, language: Column) -> Column:
    """Whether a trimmed line begins a block of the language."""
    chain = F.when(language.isin(schema.JS_FAMILY), line.rlike(schema.boundary_pattern("javascript")))
    for name in schema.BOUNDARIES:
        if name != "javascript":
            chain = chain.when(language == name, line.rlike(schema.boundary_pattern(name)))
    return chain.otherwise(F.lit(False))


def _lines(content: Column) -> Column:
    return F.transform(F.split(content, "\n", -1), trim_space)


def signature(language: Column, content: Column) -> Column:
    """The first line that declares something, trimmed; empty if there is none."""
    found = F.filter(_lines(content), lambda x: F.when(language == "go", x.startswith("func ")).otherwise(is_boundary(x, language)))
    return F.coalesce(F.get(found, 0), F.lit(""))


def _role(language: Column, content: Column, pattern: str) -> Column:
    pattern = pattern.replace(r"\s", r"[\t\n\f\r ]")
    return language.isin(schema.JS_FAMILY) & F.exists(_lines(content), lambda x: x.rlike(pattern))


def purpose(language: Column, content: Column) -> Column:
    """What a chunk seems to be for, by the words in it; tags joined by semicolons."""
    low, category = F.lower(content), category_of(language)

    def holds(*words: str) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(low, F.lit(word))
        return found

    roles = [F.when(_role(language, content, pattern), tag) for pattern, tag in schema.ROLE_TAGS]  # of languages that are all source

    def joined(default: str, parts: list[Column]) -> Column:
        text = F.concat_ws("; ", *parts)
        return F.when(text == "", F.lit(default)).otherwise(text)

    def tags(name: str) -> Column:
        default, rules = schema.CATEGORY_TAGS[name]
        return joined(default, (roles if name == "source" else []) + [F.when(holds(*words), tag) for tag, words in rules])

    def all_of(choices: list[tuple[str, ...]]) -> Column:
        found = F.lit(True)
        for words in choices:
            found = found & holds(*words)
        return found

    chain = F.when(language == "go", joined(schema.NO_TAG, [F.when(all_of(choices), tag) for tag, choices in schema.GO_TAGS]))
    for name in schema.CATEGORY_TAGS:
        if name != "source":
            chain = chain.when(category == name, tags(name))
    return chain.otherwise(tags("source"))


def semantic_content(path: Column, language: Column, content: Column) -> Column:
    """The enriched text, in sections."""
    head = signature(language, content)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), base_name(path)),
        F.concat(F.lit("Language: "), language),
        F.concat(F.lit("Category: "), category_of(language)),
        F.when(head != "", F.concat(F.lit("Signature: "), head)),
        F.concat(F.lit("Purpose: "), purpose(language, content)),
        F.concat(F.lit("Code:\n"), content),
    )
