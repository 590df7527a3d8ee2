"""Generated, minified, vendored and bulk-data source files, told by layout statistics.

Per chunk the JVM counts lines, longest line, white space, letters and digits, numeric literals and long
encoded runs; the counts of a file are sums and maxima of those of its chunks, so only a few numbers per
chunk are shuffled and a file may be of any length. The first judge is layout, by thresholds per language
(``Layout``): little white space in long lines, on the mean or in one line that is all but the whole file, is
minified; many digits, numeric literals, or encoded runs of mostly letters and digits are data. What the layout does
not tell, as such files are laid out like hand-written ones, place, name and the file's own statement tell: files of
other projects and of generators. ``told_by`` says which judge spoke.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

#: Folders that hold other projects' code.
VENDOR_FOLDERS = ["vendor", "_vendor", "node_modules", "bower_components", "third_party", "thirdparty", "3rdparty", "third-party", "external", "externals", "extern", "vendored", "subprojects", "Godeps", "Pods", "site-packages", "jspm_packages"]
#: Names that generators and bundlers give to files.
GENERATED_NAME = r"(_pb2(_grpc)?\.pyi?|\.pb(\.gw)?\.(go|cc|h|rb)|\.(generated|gen|g|designer)\.\w+|_generated\.\w+|_gen\.go|/zz_generated[^/]*)$"
MINIFIED_NAME = r"(\.min\.\w+|[.-]bundle(\.[0-9a-f]+)?\.(js|css|mjs))$"
#: A file's statement about itself is a comment line among its first ``HEADER_LINES`` lines, in the comments it begins
#: with, however many, or among its last ``FOOTER_LINES`` lines.
HEADER_LINES, FOOTER_LINES = 20, 3
CODE_LINE = r"^[ \t]*[^ \t/#*;%<\"'!-]"
_MARK = r"""^[ \t]*(?://+|#+|--+|/?\*+|<!--|;+|%+|"{3}|'{3})?!?[ \t]*"""
_MADE = r"(?:generated|produced|emitted|compiled|transpiled|machine-made)"
_TOOL = r"(?:auto(?:matically)?|machine|tool|computer|script|compiler)"
GENERATED_STATEMENT = _MARK + "(?:" + "|".join(
    [
        rf"(?:code|file|source|module|types?|bindings?|stubs?|client|parser|schema)s? {_MADE}\b",
        rf"{_TOOL}[- ]?(?:generated|written|produced|created|made|built|emitted|compiled|rendered|derived)\b",
        r"@(?:auto-?)?generated\b|<(?:auto-?)?generated\b",
        rf"{_MADE} (?:automatically |code |file |source )?(?:by|from|with|using|via|on|at|code|file)\b",
        r"(?:output|result|product) of \S",
        rf"(?:this|the) (?:\w+ ){{0,2}}(?:file|code|source|module|class|document)s? (?:is|was|are|were|has been|have been) (?:\w+ )?(?:{_TOOL}[- ])?{_MADE}\b",
        rf"(?:this|the) (?:\w+ ){{0,2}}(?:file|code|source|module|class|document)s? (?:is|was|are|were|has been|have been) {_TOOL}[- ]?\w+\b",
        r"(?:please )?(?:do not|don'?t|never) (?:manually |hand-?)?(?:edit|modify|change|touch|alter)\b",
        r"(?:any |all |your |manual |local |hand )*(?:edits|changes|modifications)(?: \w+){0,4} (?:lost|overwritten|discarded|replaced|reverted)\b",
        r"(?:to )?(?:regenerate|re-generate)(?: \w+)? (?:with|using|by|via|run)\b",
        r"source: \S+\.(?:proto|thrift|idl|graphql|fbs|avsc|avdl|xsd|wsdl|g4|schema|asn1?)\b",
        r"checksum [0-9a-f]{16,} \w+ \S+\.\w+",
        r"[#@] ?sourceMappingURL=",
        r"(?:archivo|fichero|c[oó]digo) (?:fue |es )?(?:generado|producido|creado) (?:autom|por|a partir)|generado (?:autom|por|a partir)|no (?:editar|modificar)\b",
    ]
) + ")"
VENDORED_STATEMENT = _MARK + "(?:" + "|".join(
    [
        r"(?:vendored|imported|copied|forked|mirrored|adopted|taken|borrowed|synced|pulled|extracted|bundled|cloned|ported|reproduced|lifted)(?: [\w,'-]+){0,4} (?:from|of)\b",
        r"(?:(?:this|the) (?:\w+ ){0,2}(?:file|code|source|directory|module) (?:is|was|has been) )(?:a )?(?:vendored|copied|imported|taken|forked|copy|snapshot|mirror|borrowed)\b",
        r"(?:imported |vendored |verbatim |unmodified |local |frozen )?(?:snapshot|copy|mirror|fork|import) of \S+",
        r"(?:upstream|origin|original source)(?: \w+)?: ?\S+",
        r"third[- ]party (?:code|library|source|file|module|component)",
        r"keep in (?:step|sync) with upstream",
        r"@?(?:license|preserve)?:? ?[\w@./-]+ v?\d+\.\d+[\w.+-]* ?[|,;·–—-] ?(?:\(c\)|©|copyright|licen[cs]ed?|released|mit\b|bsd\b|apache\b)",
    ]
) + ")"
#: Lines with these are templates of statements or deny what they mention.
NO_STATEMENT = r"(?i)%[sdvq]\b|\{\{|\$\{|\{\w*\}|<%|\bunlike\b|\bhand-?written\b|(?:kept|written|maintained|made|edited) by hand\b|\bnot (?:auto-?)?(?:generated|vendored|copied)\b|hecho a mano"



class Layout(NamedTuple):
    """A file of ``chars`` or more is minified below ``space`` (share of white space) if the mean line is longer than
    ``mean``, or the longest one than ``LONGEST`` and ``LONGEST_SHARE`` of the file; it is data above ``digits`` (share),
    ``numbers`` (literals a character) or ``encoded`` (share of long encoded runs, with ``ENCODED_ALNUM`` of letters and digits).
    """

    space: float = 0.05
    mean: float = 200.0
    digits: float = 0.25
    encoded: float = 0.5
    chars: int = 300
    numbers: float = 0.06


LONGEST, LONGEST_SHARE, ENCODED_ALNUM = 500, 0.9, 0.6
_SETTINGS = Layout(space=0.02, mean=400.0, digits=0.45, encoded=0.8, numbers=0.1)
#: By language; the others have the defaults. Settings and prose hold digests and keys beside little text.
THRESHOLDS = {
    "": Layout(),
    "javascript": Layout(space=0.07, mean=100.0),
    "typescript": Layout(space=0.07, mean=100.0),
    "css": Layout(space=0.08, mean=100.0, digits=0.30, numbers=0.1),
    "json": Layout(space=0.02, mean=400.0, digits=0.35, numbers=0.1),
    "properties": _SETTINGS._replace(space=0.01, digits=0.40),
    "yaml": _SETTINGS,
    "toml": _SETTINGS,
    "dockerfile": _SETTINGS,
    "markdown": _SETTINGS._replace(digits=0.40),
}
ENCODED_RUN = r"[A-Za-z0-9+/=]{40,}"
NUMBER = r"\b[0-9][0-9A-Fa-fxX._]*\b"


def _threshold(name: str) -> Column:
    pairs = [x for language, row in THRESHOLDS.items() if language for x in (F.lit(language), F.lit(getattr(row, name)))]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(F.col("language"), F.lit(""))], F.lit(getattr(THRESHOLDS[""], name)))


def layout_statistics(chunks: DataFrame) -> DataFrame:
    """One row per project and path, of its current revision: counts, shares and header flags.

    Ids delivered twice count once; NULL contents count as empty; a NULL revision is older than any. Rows
    without path have no file and are left out. Columns other than those of the chunk table are not read.
    """
    text = F.coalesce("content", F.lit(""))
    lines = F.split(text, "\n", -1)
    first = F.coalesce("start_line", F.lit(1))
    opening = F.when(first == 1, F.slice(lines, HEADER_LINES + 1, F.greatest(F.size(lines), F.lit(1))))
    code = F.array_position(F.transform(opening, lambda x: x.rlike(CODE_LINE)), True)  # 0: comments to the chunk's end
    begin = F.array_position(F.transform(F.slice(lines, 1, HEADER_LINES), lambda x: x.rlike(CODE_LINE)), True)
    more = F.when((first == 1) & (begin == 0), F.when(code > 0, code - 1).otherwise(F.size(opening))).otherwise(0)
    head = F.slice(lines, 1, (F.greatest(F.lit(HEADER_LINES + 1) - first, F.lit(0)) + more).cast("int"))
    tail = F.slice(lines, -F.least(F.size(lines), F.lit(FOOTER_LINES)), FOOTER_LINES)
    says = lambda part, pattern: F.exists(part, lambda x: x.rlike("(?i)" + pattern) & ~x.rlike(NO_STATEMENT)).cast("int")
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    facts = F.struct(
        F.length(text).alias("chars"),
        F.size(lines).alias("lines"),
        F.array_max(F.transform(lines, F.length)).alias("longest"),
        without(" \t\r\n").alias("space"),
        without("0123456789").alias("digits"),
        without("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("letters"),
        F.regexp_count(text, F.lit(NUMBER)).alias("numbers"),
        (F.length(text) - F.length(F.regexp_replace(text, ENCODED_RUN, ""))).alias("encoded"),
        says(head, GENERATED_STATEMENT).alias("generated"),
        says(head, VENDORED_STATEMENT).alias("vendored"),
        # of a file's last chunk, which has the greatest line number
        F.struct(first.alias("at"), says(tail, GENERATED_STATEMENT).alias("generated"), says(tail, VENDORED_STATEMENT).alias("vendored")).alias("last"),
    )
    slim = spread(chunks.where("file_path IS NOT NULL").select("project", "file_path", "revision", "id", "language", "start_line", "content"))
    rows = slim.select("project", "file_path", "revision", "id", "language", facts.alias("f"))
    key = ["project", "file_path", "revision"]
    once = rows.groupBy("id", *key).agg(F.max("f").alias("f"), F.max("language").alias("language"))
    sums = [F.sum(f"f.{c}").alias(c) for c in ("chars", "lines", "space", "digits", "letters", "numbers", "encoded")]
    maxima = [F.max(f"f.{c}").alias(c) for c in ("longest", "generated", "vendored", "last")]
    revisions = once.groupBy(*key).agg(F.max("language").alias("language"), *sums, *maxima)
    names = [c for c in revisions.columns if c not in key]
    top = revisions.groupBy("project", "file_path").agg(F.max(F.struct("revision", *names)).alias("r"))
    flat = top.select("project", "file_path", *(f"r.{c}" for c in names))
    flat = flat.withColumns({c: F.greatest(c, f"last.{c}") for c in ("generated", "vendored")})
    of = lambda c: F.col(c) / F.greatest("chars", F.lit(1))
    return flat.select(
        "project", "file_path", "language", "chars", "lines", "longest", "generated", "vendored",
        (F.col("chars") / F.greatest("lines", F.lit(1))).alias("mean_line"),
        of("space").alias("space_share"), of("digits").alias("digit_share"),
        ((F.col("letters") + F.col("digits")) / F.greatest("chars", F.lit(1))).alias("alnum_share"),
        of("numbers").alias("number_density"), of("encoded").alias("encoded_share"),
    )


def classify_files(chunks: DataFrame) -> DataFrame:
    """``project, file_path, language, kind, told_by``: ``minified`` or ``data`` (by ``layout``), ``vendored`` or ``generated``
    (by ``place``, which is folder or name, or by ``statement``), ``minified`` by its name, or ``hand-written`` (by nothing).

    The first that holds, in this order. A single long line, or words about generated code that are no
    statement at a file's start or end, make no file anything but hand-written.
    """
    path = F.concat(F.lit("/"), F.col("file_path"))
    inside = path.rlike("/(" + "|".join(VENDOR_FOLDERS) + ")/")
    long_enough = F.col("chars") >= _threshold("chars")
    one_line = (F.col("longest") > LONGEST) & (F.col("longest") >= F.col("chars") * LONGEST_SHARE)
    minified = long_enough & (F.col("space_share") < _threshold("space")) & ((F.col("mean_line") > _threshold("mean")) | one_line)
    encoded = (F.col("encoded_share") > _threshold("encoded")) & (F.col("alnum_share") > ENCODED_ALNUM)
    data = long_enough & ((F.col("digit_share") > _threshold("digits")) | (F.col("number_density") > _threshold("numbers")) | encoded)
    told = lambda kind, by: F.struct(F.lit(kind).alias("kind"), F.lit(by).alias("told_by"))
    verdict = (
        F.when(minified, told("minified", "layout"))
        .when(data, told("data", "layout"))
        .when(inside, told("vendored", "place"))
        .when(F.col("vendored") > 0, told("vendored", "statement"))
        .when(path.rlike(GENERATED_NAME), told("generated", "place"))
        .when(F.col("generated") > 0, told("generated", "statement"))
        .when(path.rlike(MINIFIED_NAME), told("minified", "place"))
        .otherwise(told("hand-written", None))
    )
    return layout_statistics(chunks).select("project", "file_path", "language", verdict.alias("v")).select("project", "file_path", "language", "v.kind", "v.told_by")


def not_handwritten(chunks: DataFrame) -> DataFrame:
    """``file_path``: files that are, as a whole, not hand-written."""
    return classify_files(chunks).where("kind <> 'hand-written'").select("file_path").distinct()


def handwritten_chunks(chunks: DataFrame) -> DataFrame:
    """The chunk rows, columns unchanged, of files that are hand-written."""
    kept = classify_files(chunks).where("kind = 'hand-written'").select("project", "file_path")
    return chunks.join(kept, chunks["project"].eqNullSafe(kept["project"]) & (chunks["file_path"] == kept["file_path"]), "left_semi")
