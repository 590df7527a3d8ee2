"""Schemas and fixed values of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("category", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    ]
)
METADATA_FIELDS = ["provider", "model", "dimensions"]
_RANGE = T.StructType().add("file", "string").add("start_line", "integer").add("end_line", "integer")
_QUERY = T.StructType().add("name", "string").add("query", "string").add("expected_files", T.ArrayType(T.StringType())).add("expected_chunks", T.ArrayType(_RANGE))
FIXTURE_SCHEMA = T.StructType().add("name", "string").add("queries", T.ArrayType(_QUERY))
#: A changed file; ``sequence`` (an offset, a version, an event's microseconds) tells which of several changes is the last.
FILE_SCHEMA = T.StructType().add("file_path", "string").add("content", "string").add("sequence", "long")

#: Search depths.
CANDIDATES, RESULTS, WINDOWS = 25, 5, (3, 5)
#: Fixed value: lines of a tumbling chunk.
MAX_LINES = 10
#: Ranking weights and limits.
EXACT_PHRASE, TOKEN_OVERLAP, FILE_NAME, ACTIONABLE, BUILD_ARTIFACT = 0.08, 0.18, 0.06, 0.04, 0.25
PER_FILE, SLACK_LINES = 2, 12

#: Categories that are never searched semantically nor indexed.
UNINDEXED = ["docs", "dependency_metadata"]
#: Folders that are never scanned (the fourth is the engine's own), parts of paths of built files, beginnings
#: of code to act on, and words that rank nothing.
EXCLUDED_DIRS = [".git", "node_modules", ".opencode", ".codelode", "coverage", "playwright-report", "test-results", "dist", ".next", "build"]
ARTIFACT_MARKERS = ["/dist/", "/coverage/", "/build/", "/.next/", "/playwright-report/", "/test-results/"]
ACTIONABLE_PREFIXES = ["func ", "export function ", "function ", "class ", "export class ", "type ", "const use", "function use", "test(", "it(", "describe("]
STOP_TOKENS = ["the", "and", "for", "with", "that", "this", "from", "into", "only", "part", "flow", "code"]

#: File names and extensions of each language.
NAME_RULES = [  # kind of match, text, language; the first that holds counts
    ("is", "Dockerfile", "dockerfile"),
    ("starts", "Dockerfile.", "dockerfile"),
    ("is", "Makefile", "makefile"),
    ("is", ".editorconfig", "ini"),
    ("is", ".gitignore", "gitignore"),
    ("is", ".prettierignore", "gitignore"),
    ("is", ".eslintignore", "gitignore"),
    ("is", ".npmrc", "config"),
    ("is", ".yarnrc", "config"),
    ("is", ".nvmrc", "config"),
    ("is", ".prettierrc", "config"),
    ("is", ".tool-versions", "config"),
    ("is", "gradlew", "shell"),
    ("is", "mvnw", "shell"),
    ("ends", ".gradle.kts", "gradle"),
    ("ends", ".lock", "lockfile"),
    ("is", "bun.lockb", "lockfile"),
    ("compose", "docker-compose", "yaml.compose"),
    ("is", "BUILD", "bazel.build"),
    ("is", "BUILD.bazel", "bazel.build"),
    ("is", "WORKSPACE", "bazel.workspace"),
    ("is", "MODULE.bazel", "bazel.module"),
]
EXTENSIONS = {
    "go": "go", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "py": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "json": "json", "sh": "shell", "md": "markdown", "mdx": "markdown", "toml": "toml", "ini": "ini",
    "conf": "config", "xml": "xml", "properties": "properties", "gradle": "gradle", "sql": "sql", "proto": "proto", "graphql": "graphql", "gql": "graphql",
    "css": "css", "scss": "scss", "sass": "sass", "less": "less", "yml": "yaml", "yaml": "yaml", "bzl": "bazel.bzl",
}
#: Categories of languages; all others are ``source``.
CATEGORIES = {
    "shell": "scripts", "markdown": "docs", "gitignore": "docs", "json": "dependency_metadata", "toml": "dependency_metadata", "properties": "dependency_metadata",
    "xml": "dependency_metadata", "makefile": "dependency_metadata", "gradle": "dependency_metadata", "lockfile": "dependency_metadata",
    "ini": "infra_config", "config": "infra_config", "dockerfile": "infra_config",
}

#: What begins a block, matched against the trimmed line.
JS_FAMILY = ["javascript", "typescript", "tsx", "jsx"]
GO_FUNCTION = r"^func\s+"
JS_COMPONENT = r"^(export\s+default\s+function\s+[A-Z][\w$]*|export\s+function\s+[A-Z][\w$]*|function\s+[A-Z][\w$]*|export\s+default\s+(const|let|var)\s+[A-Z][\w$]*\s*=|export\s+(const|let|var)\s+[A-Z][\w$]*\s*=|(const|let|var)\s+[A-Z][\w$]*\s*=)"
JS_HOOK = r"^(export\s+)?function\s+use[A-Z][\w$]*|^(export\s+)?(const|let|var)\s+use[A-Z][\w$]*\s*="
JS_TEST = r"^(describe|it|test)\s*\("
BOUNDARIES = {
    "javascript": [
        r"^(export\s+)?(async\s+)?function\s+|^(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s*)?\(",
        r"^(export\s+)?(const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*(async\s*)?(\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>",
        JS_COMPONENT,
        JS_HOOK,
        r"^(export\s+default\s+)?class\s+[A-Za-z_$][\w$]*|^export\s+class\s+[A-Za-z_$][\w$]*",
        JS_TEST,
    ],
    "python": [r"^(def|class)\s+"],
    "java": [r"^(public|protected|private|static|final|abstract|class|interface|enum|record)\s+"],
    "shell": [r"^(function\s+\w+|\w+\s*\(\)\s*\{|if\s|for\s|while\s|case\s)"],
    "markdown": [r"^(#{1,4}\s|[-*]\s|\d+\.\s|~~~)"],
}


def boundary_pattern(language: str) -> str | None:
    """One pattern for the starts of the language's blocks, or None where there are none."""
    patterns = BOUNDARIES.get("javascript" if language in JS_FAMILY else language)
    return None if patterns is None else "|".join(f"(?:{p})" for p in patterns).replace(r"\s", r"[\t\n\f\r ]")


#: What a chunk seems to be for, told by words in it. A tag with several words needs one of them; those of
#: ``GO_TAGS`` that are given as a list of choices need one of each.
GO_TAGS = [
    ("adds or combines two integers; suma dos numeros enteros", [("return a + b", "suma")]),
    ("subtracts two integers; resta dos numeros enteros", [("return a - b", "resta")]),
    ("multiplies two integers; multiplica dos numeros enteros", [("return a * b", "multiplicacion")]),
    ("divides two integers; divide dos numeros enteros", [("return a / b", "division")]),
    ("function operating on integer values", [("func ",), (" int",)]),
]
ROLE_TAGS = [(JS_COMPONENT, "react component"), (JS_HOOK, "custom hook"), (JS_TEST, "test block"), ("^export ", "exported api")]
CATEGORY_TAGS = {  # category -> what to say without any, the tags
    "docs": ("documentation content", [("documentation or usage instructions", ("install", "usage"))]),
    "scripts": ("script or automation block", [("shell script entrypoint", ("#!/bin/",)), ("environment or execution setup", ("export ", "set -"))]),
    "dependency_metadata": ("project or dependency metadata", [("dependency or project metadata", ("dependencies", "require"))]),
    "infra_config": ("infrastructure or configuration block", [("container or image configuration", ("image:", "docker")), ("service configuration", ("service",)), ("build or workspace configuration", ("rule", "load("))]),
    "source": ("code block", [("network or api access", ("fetch", "axios")), ("function or callable block", ("def ", "function ", "=>")), ("class definition", ("class ",)), ("returns computed values", ("return",))]),
}
NO_TAG = "code block"
