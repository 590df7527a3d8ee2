"""Language, category and path predicates, from the tables in ``schema``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from .text import base_name, trim_space


def language_of(path: Column) -> Column:
    """The language of a file by its name; NULL where it is not supported."""
    base = base_name(path)
    low = F.lower(base)
    tests = {
        "is": lambda t: base == t,
        "starts": lambda t: base.startswith(t),
        "ends": lambda t: base.endswith(t),
        "compose": lambda t: low.startswith(t) & (low.endswith(".yml") | low.endswith(".yaml")),
    }
    kind, text, language = schema.NAME_RULES[0]
    chain = F.when(tests[kind](text), language)
    for kind, text, language in schema.NAME_RULES[1:]:
        chain = chain.when(tests[kind](text), language)
    table = F.create_map(*(F.lit(x) for pair in schema.EXTENSIONS.items() for x in pair))
    extension = F.when(base.contains("."), F.substring_index(low, ".", -1)).otherwise(F.lit(""))
    return chain.otherwise(F.try_element_at(table, extension))


def category_of(language: Column) -> Column:
    """The category of a language."""
    table = F.create_map(*(F.lit(x) for pair in schema.CATEGORIES.items() for x in pair))
    named = F.when(language.startswith("yaml") | language.startswith("bazel"), "infra_config").otherwise(F.try_element_at(table, language))
    return F.when(language.isNotNull(), F.coalesce(named, F.lit("source")))


def category_or_default(category: Column, language: Column) -> Column:
    """A stored category, or, for rows from before there was one, a coarse one by language."""
    infra = (language == "dockerfile") | language.startswith("yaml") | language.startswith("bazel")
    return F.when(category.isNotNull() & (trim_space(category) != ""), category).when(infra, F.lit("infra_config")).otherwise(F.lit("source"))


def is_indexable(category: Column) -> Column:
    return ~category.isin(schema.UNINDEXED)


def is_semantic(category: Column) -> Column:
    """Rows that semantic search looks at: those without a category, too."""
    return category.isNull() | ~category.isin(schema.UNINDEXED)


def in_excluded_dir(path: Column) -> Column:
    """Whether one of the path's folders is never scanned."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*(F.lit(d) for d in schema.EXCLUDED_DIRS)))


def is_build_artifact(path: Column) -> Column:
    low = F.lower(path)
    found = F.lit(False)
    for marker in schema.ARTIFACT_MARKERS:
        found = found | F.contains(low, F.lit(marker))
    return found


def is_actionable(category: Column, content: Column) -> Column:
    """Source by category, or text that starts like a declaration or a test."""
    text = trim_space(content)
    found = category.eqNullSafe("source")
    for prefix in schema.ACTIONABLE_PREFIXES:
        found = found | text.startswith(prefix)
    return found


def under(path: Column, root: str) -> Column:
    """The root itself or a path below it; wildcards in the root mean nothing."""
    return (path == root) | path.startswith(root.rstrip("/") + "/")
