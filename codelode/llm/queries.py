"""The training-data queries: name, builder, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table
from . import handwritten, knn, lookalike, mixing, neardup, packing, secrets, splitting, syntax

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_VECTORS = "v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM code_chunks WHERE len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0)"


@query(
    "p2_found",
    f"""WITH {_VECTORS},
p AS (SELECT a.id AS q, b.id AS n, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.92),
r AS (SELECT q, n FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, n) <= 10)
SELECT DISTINCT least(q, n) AS id_a, greatest(q, n) AS id_b FROM r""",
)
def p2_found(spark, sf_dir):
    return knn.similar_pairs(table(spark, sf_dir, "code_chunks"))


@query(
    "p2_similar",
    """WITH v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e, len(embedding) AS size FROM code_chunks WHERE len(embedding) > 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
p AS (SELECT a.size, a.id AS query, b.id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id AND a.size = b.size WHERE list_cosine_similarity(a.e, b.e) >= 0.92)
SELECT size::INTEGER AS size, query, id, round(s, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY s DESC, id)::INTEGER AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 10""",
)
def p2_similar(spark, sf_dir):
    return knn.neighbours_of_all(table(spark, sf_dir, "code_chunks")).withColumn("cosine", F.round("cosine", 6))


@query(
    "p2_nearest_of_queries",
    f"""WITH {_VECTORS},
p AS (SELECT a.id AS query, b.id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0)
SELECT query, id, round(s, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY s DESC, id)::INTEGER AS rank FROM p
QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 10""",
)
def p2_nearest_of_queries(spark, sf_dir):
    chunks = table(spark, sf_dir, "code_chunks")
    near = knn.exact_neighbours(chunks, chunks.where("id % 50 = 0"))
    return near.select("query", "id", F.round("cosine", 6).alias("cosine"), "rank")


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "code_chunks")


_SHINGLES = """d AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM code_chunks WHERE content IS NOT NULL),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 30),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
r AS (SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.7)"""


@query("p6_found", f"WITH {_SHINGLES} SELECT id_a, id_b FROM r")
def p6_found(spark, sf_dir):
    return neardup.near_duplicate_pairs(_chunks(spark, sf_dir), threshold=0.7, width=3, min_words=30)


@query(
    "p6_links",
    f"""WITH {_SHINGLES}, c AS (SELECT w, min(id) AS class_id FROM d WHERE len(w) >= 30 GROUP BY w), m AS (SELECT d.id, c.class_id FROM d JOIN c ON c.w = d.w),
e AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM (SELECT id_a, id_b FROM r UNION ALL SELECT id_b, id_a FROM r) r JOIN m x ON x.id = r.id_a JOIN m y ON y.id = r.id_b WHERE x.class_id <> y.class_id)
SELECT m.id, m.class_id, count(e.b) AS links FROM m LEFT JOIN e ON e.a = m.class_id GROUP BY ALL""",
)
def p6_links(spark, sf_dir):
    return neardup.link_counts(_chunks(spark, sf_dir), threshold=0.7, width=3, min_words=30)


@query(
    "p6_groups",
    f"""WITH RECURSIVE {_SHINGLES}, c AS (SELECT w, min(id) AS class_id FROM d WHERE len(w) >= 30 GROUP BY w), m AS (SELECT d.id, c.class_id FROM d JOIN c ON c.w = d.w),
l AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM r JOIN m x ON x.id = r.id_a JOIN m y ON y.id = r.id_b WHERE x.class_id <> y.class_id), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
g AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT g.a, e.b FROM g JOIN e ON e.a = g.b)
SELECT m.id, m.class_id, h.group_id FROM m JOIN (SELECT a, min(b) AS group_id FROM g GROUP BY a) h ON h.a = m.class_id""",
)
def p6_groups(spark, sf_dir):
    return neardup.near_duplicate_groups(_chunks(spark, sf_dir), threshold=0.7, width=3, min_words=30)


def _normal(text: str) -> str:
    """A normal form for problem 10 in DuckDB's own terms: invisible characters dropped, decomposed letters composed,
    full-width forms and other spaces made ordinary, letters of other alphabets made Latin, mark by mark.
    """
    wide = "(SELECT string_agg(chr((65280 + i)::INTEGER), '' ORDER BY i) || chr(12288) || chr(160) || chr(8199) || chr(8239) FROM range(1, 95) AS u(i))"
    plain = "(SELECT string_agg(chr((32 + i)::INTEGER), '' ORDER BY i) || '    ' FROM range(1, 95) AS u(i))"
    other = "'АВЕЅІЈКМНОРСТУХаеіјорсухѕһԁԛԝԚԜёЁїЇΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορυάίόύΆΈΉΊΌΎϊϋΪΫՕՏօսհ'"
    latin = "'ABESIJKMHOPCTYXaeijopcyxshdqwQWëËïÏABEZHIKMNOPTYXayivopuáíóúÁÉHÍÓÝïüÏŸOSouh'"
    return f"nfc_normalize(translate(translate(nfc_normalize(regexp_replace({text}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FEFF}}]', '', 'g')), {wide}, {plain}), {other}, {latin}))"


_FORMS = f"n AS (SELECT DISTINCT doc_id, text, {_normal('text')} AS form FROM documents WHERE text IS NOT NULL)"


@query("p10_found", f"WITH {_FORMS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM n a JOIN n b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text")
def p10_found(spark, sf_dir):
    return lookalike.all_same_looking_pairs(table(spark, sf_dir, "documents"))


@query(
    "p10_groups",
    f"""WITH {_FORMS}, t AS (SELECT form, text, min(doc_id) AS text_id, count(*) AS copies FROM n GROUP BY ALL), f AS (SELECT form, min(text_id) AS form_id, count(*) AS texts, sum(copies) AS documents FROM t GROUP BY form)
SELECT n.doc_id, t.text_id, f.form_id, f.texts, (f.documents - t.copies)::BIGINT AS links FROM n JOIN t ON t.text = n.text JOIN f ON f.form = n.form""",
)
def p10_groups(spark, sf_dir):
    return lookalike.same_looking_groups(table(spark, sf_dir, "documents"))


@query("p10_forms")
def p10_forms(spark, sf_dir):
    forms = lookalike.consistent_forms(table(spark, sf_dir, "documents"))
    return forms.select("doc_id", "form", (F.col("form") != F.col("text")).alias("rewritten"))


# Problem 3 in SQL: layout by counts of one pass over the joined text, with the thresholds written out, and the same
# statements, of which the patterns are shared, as they are a list of fixed phrases.
_text_of = lambda s: "'" + s.replace("'", "''") + "'"
_says = lambda p, x: f"regexp_matches({x}, {_text_of('(?i)' + p)}) AND NOT regexp_matches({x}, {_text_of(handwritten.NO_STATEMENT)})"
_FILES = f"""one AS (SELECT DISTINCT id, project, file_path, revision, start_line, language, coalesce(content, '') AS t FROM code_chunks WHERE file_path IS NOT NULL),
cur AS (SELECT *, max(start_line) OVER (PARTITION BY project, file_path, revision) AS last FROM one QUALIFY revision = max(revision) OVER (PARTITION BY project, file_path)),
f AS (SELECT project, file_path, max(language) AS language, sum(length(t)) AS c, sum(len(string_split(t, chr(10)))) AS n, max(list_max(list_transform(string_split(t, chr(10)), lambda x: length(x)))) AS longest,
 sum(length(t) - length(regexp_replace(t, '[ \t\r\n]', '', 'g'))) AS space, sum(length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) AS digits, sum(length(t) - length(regexp_replace(t, '[0-9A-Za-z]', '', 'g'))) AS alnum,
 sum(len(regexp_extract_all(t, '\b[0-9][0-9A-Fa-fxX._]*\b'))) AS numbers, sum(length(t) - length(regexp_replace(t, '[A-Za-z0-9+/=]{{40,}}', '', 'g'))) AS encoded FROM cur GROUP BY project, file_path),
lay AS (SELECT project, file_path, language, CASE WHEN c < 300 THEN NULL
 WHEN space / c < CASE WHEN language IN ('javascript', 'typescript') THEN 0.07 WHEN language = 'css' THEN 0.08 WHEN language = 'properties' THEN 0.01 WHEN language IN ('json', 'yaml', 'toml', 'dockerfile', 'markdown') THEN 0.02 ELSE 0.05 END
  AND (c / n > CASE WHEN language IN ('javascript', 'typescript', 'css') THEN 100 WHEN language IN ('json', 'properties', 'yaml', 'toml', 'dockerfile', 'markdown') THEN 400 ELSE 200 END OR longest > 500 AND longest >= 0.9 * c) THEN 'minified'
 WHEN digits / c > CASE WHEN language = 'css' THEN 0.3 WHEN language = 'json' THEN 0.35 WHEN language IN ('properties', 'markdown') THEN 0.4 WHEN language IN ('yaml', 'toml', 'dockerfile') THEN 0.45 ELSE 0.25 END
  OR numbers / c > CASE WHEN language IN ('css', 'json', 'properties', 'yaml', 'toml', 'dockerfile', 'markdown') THEN 0.1 ELSE 0.06 END
  OR encoded / c > CASE WHEN language IN ('properties', 'yaml', 'toml', 'dockerfile', 'markdown') THEN 0.8 ELSE 0.5 END AND alnum / c > 0.6 THEN 'data' END AS kind FROM f)"""
_STATED = f"""line AS (SELECT project, file_path, start_line, last, i, string_split(t, chr(10))[i] AS x, len(string_split(t, chr(10))) AS of FROM cur, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(i)),
lead AS (SELECT project, file_path, coalesce(min(CASE WHEN regexp_matches(x, {_text_of(handwritten.CODE_LINE)}) THEN i END), 1000000000) AS code FROM line WHERE start_line = 1 GROUP BY ALL),
said AS (SELECT l.* FROM line l LEFT JOIN lead ON lead.project = l.project AND lead.file_path = l.file_path WHERE start_line + i - 1 <= 20 OR start_line = 1 AND i < code OR start_line = last AND i > of - 3),
st AS (SELECT project, file_path, bool_or({_says(handwritten.GENERATED_STATEMENT, "x")}) AS generated, bool_or({_says(handwritten.VENDORED_STATEMENT, "x")}) AS vendored FROM said GROUP BY ALL),
k AS (SELECT lay.project, lay.file_path, language, CASE WHEN kind IS NOT NULL THEN kind WHEN regexp_matches('/' || lay.file_path, '/({"|".join(handwritten.VENDOR_FOLDERS)})/') OR vendored THEN 'vendored'
 WHEN regexp_matches('/' || lay.file_path, {_text_of(handwritten.GENERATED_NAME)}) OR generated THEN 'generated' WHEN regexp_matches('/' || lay.file_path, {_text_of(handwritten.MINIFIED_NAME)}) THEN 'minified' ELSE 'hand-written' END AS kind
 FROM lay LEFT JOIN st ON st.project = lay.project AND st.file_path = lay.file_path)"""


@query("p3_found", f"WITH {_FILES}, {_STATED} SELECT DISTINCT file_path FROM k WHERE kind <> 'hand-written'")
def p3_found(spark, sf_dir):
    return handwritten.not_handwritten(_chunks(spark, sf_dir))


@query("p3_kinds", f"WITH {_FILES}, {_STATED} SELECT project, language, kind, count(*) AS files FROM k GROUP BY ALL")
def p3_kinds(spark, sf_dir):
    return handwritten.classify_files(_chunks(spark, sf_dir)).groupBy("project", "language", "kind").agg(F.count("*").alias("files"))


@query("p3_layout", f"WITH {_FILES} SELECT project, file_path, kind FROM lay WHERE kind IS NOT NULL")
def p3_layout(spark, sf_dir):
    """What layout tells by itself."""
    return handwritten.classify_files(_chunks(spark, sf_dir)).where("told_by = 'layout'").select("project", "file_path", "kind")


@query("p5_found")
def p5_found(spark, sf_dir):
    return secrets.secret_lines(_chunks(spark, sf_dir))


@query("p5_redacted")
def p5_redacted(spark, sf_dir):
    return secrets.redacted_chunks(_chunks(spark, sf_dir)).select("id", "file_path", "start_line", "content")


@query("p4_found", "SELECT DISTINCT id FROM code_chunks JOIN chunk_limits USING (language) WHERE length(content) > max_chars")
def p4_found(spark, sf_dir):
    return splitting.oversized_ids(_chunks(spark, sf_dir), table(spark, sf_dir, "chunk_limits"))


@query("p4_pieces")
def p4_pieces(spark, sf_dir):
    return splitting.split_chunks(_chunks(spark, sf_dir), table(spark, sf_dir, "chunk_limits"))


@query("p4_rejoined", "SELECT DISTINCT id, md5(content) AS text, true AS within_limit, start_line, end_line FROM code_chunks JOIN chunk_limits USING (language) WHERE length(content) > max_chars")
def p4_rejoined(spark, sf_dir):
    """The pieces of each oversized chunk put together again without their overlaps, and whether all keep the limit."""
    limits = table(spark, sf_dir, "chunk_limits")
    pieces = splitting.split_chunks(_chunks(spark, sf_dir), limits).join(limits, "language")
    before = Window.partitionBy("id").orderBy("piece_no")
    fresh = F.col("start_char") - F.coalesce(F.lag("end_char").over(before), F.lit(0))  # 0, or minus the overlap
    new = pieces.select("id", "piece_no", "start_line", "end_line", (F.length("content") <= F.col("max_chars")).alias("fits"), F.substring("content", F.lit(1) - fresh, F.length("content")).alias("new"))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "new")))  # of one chunk
    whole = new.groupBy("id").agg(parts.alias("p"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("fits").alias("within_limit"))
    return whole.select("id", F.md5(F.array_join("p.new", "")).alias("text"), "within_limit", "start_line", "end_line")


@query("p4_replaced")
def p4_replaced(spark, sf_dir):
    slim = _chunks(spark, sf_dir).select("id", "project", "file_path", "language", "content", "start_line", "end_line")
    return splitting.replace_oversized(slim, table(spark, sf_dir, "chunk_limits"))


@query("p7_found")
def p7_found(spark, sf_dir):
    return syntax.invalid_files(_chunks(spark, sf_dir)).select("file_path").distinct()


@query("p7_rates")
def p7_rates(spark, sf_dir):
    return syntax.invalid_rates(_chunks(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(
    "p7_json",
    """WITH one AS (SELECT DISTINCT id, project, file_path, revision, start_line, coalesce(content, '') AS content FROM code_chunks WHERE language = 'json'), cur AS (SELECT * FROM one QUALIFY revision = max(revision) OVER (PARTITION BY project, file_path))
SELECT project, file_path, json_valid(string_agg(content, chr(10) ORDER BY start_line)) AS valid FROM cur GROUP BY project, file_path""",
)
def p7_json(spark, sf_dir):
    return syntax.repaired_files(_chunks(spark, sf_dir).where("language = 'json'")).select("project", "file_path", (F.col("edits") == 0).alias("valid"))


@query("p7_diagnoses")
def p7_diagnoses(spark, sf_dir):
    return syntax.diagnoses(_chunks(spark, sf_dir)).where("edits > 0")


@query("p8_packing")
def p8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


@query("p8_summary")
def p8_summary(spark, sf_dir):
    return packing.container_summary(p8_packing(spark, sf_dir))


@query(
    "p8_invariants",
    "SELECT container, capacity_tokens::BIGINT AS capacity, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, 0::BIGINT AS lost_or_repeated, 0::BIGINT AS torn, 0::BIGINT AS overfull FROM pack_limits",
)
def p8_invariants(spark, sf_dir):
    """Documents per container kind; those whose pieces do not follow each other, those cut without need, and containers over capacity."""
    return packing.packing_faults(p8_packing(spark, sf_dir))


@query("p9_mix")
def p9_mix(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query("p9_shares")
def p9_shares(spark, sf_dir):
    return mixing.actual_shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@query(
    "p9_invariants",
    "SELECT t.source, t.max_repeats, 0::BIGINT AS unknown, 0::BIGINT AS repeated, 0::BIGINT AS beyond_cap, true AS share_met FROM mix_targets t WHERE EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0)",
)
def p9_invariants(spark, sf_dir):
    """Per source: drawn documents that are not its own, those drawn in several rows, beyond the cap, and whether the share is met to 0.01 or one document."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mixing.mix_faults(p9_mix(spark, sf_dir), documents, targets)
