"""Queries on reports of a run, exports, budgets and saved graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.vocab import BLOOM
from lectern.operators import chunking, generation, graph, profile, questions, reports
from lectern.sources import exports

from .pages import _CHUNKS, _TITLED
from .pages import SQL as PAGES
from .units import _CHECKED, _PREP, EDGE, KU, MCQ
from .views import sql_view, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Each source is a file; some have lost pages, of some the number of pages is not known. Questions and calls are dealt to
# sources by number; a fifth of the calls belong to none.
_N = "CAST(substr(doc_id, 4) AS INT)"
_FILE = f"SELECT doc_id, CASE WHEN {_N} % 5 = 0 THEN NULL ELSE count(*) + {_N} % 4 END AS total_pages FROM page_src GROUP BY doc_id"
_MAP = lambda src, key, name: f"{name} AS (SELECT doc_id, string_agg(k || '=' || n, ',' ORDER BY k) AS {name}_s FROM (SELECT doc_id, {key} AS k, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY doc_id)"
_ROBUST = f"""WITH {sql_view('page_src')}, fi AS ({_FILE}), pf AS ({PAGES['document_profile']}), ck AS ({PAGES['chunks_by_title']}),
vd AS (WITH {MCQ}, {_CHECKED} SELECT 'src' || (ord % 20) AS doc_id, layer, split_part(reason, ':', 1) AS reason, bloom_level FROM v),
{sql_view('call_log')}, cl AS (SELECT 'src' || (event_id % 25) AS doc_id, CASE WHEN event_id % 17 = 0 THEN 'skipped' ELSE status END AS status, provider, model, latency_seconds FROM call_log),
ok AS (SELECT *, provider || '/' || model AS k FROM cl WHERE status = 'success' AND latency_seconds > 0), rj AS (SELECT * FROM vd WHERE layer IS NOT NULL),
{_MAP('ck', 'chunk_type', 'ct')}, {_MAP('ok', 'k', 'pc')}, {_MAP('rj', 'reason', 'rr')},
ca AS (SELECT doc_id, count(*) AS total_chunks, count(*) FILTER (chunk_type = 'conceptual') AS con FROM ck GROUP BY doc_id),
va AS (SELECT doc_id, count(*) AS total_raw_mcqs, count(*) FILTER (layer IS NULL) AS valid_mcqs, count(*) FILTER (layer = 'schema') AS schema_rejected, count(*) FILTER (layer = 'quality') AS quality_rejected,
  {" || ',' || ".join(f"'{b}=' || count(*) FILTER (layer IS NULL AND bloom_level = '{b}')" for b in BLOOM)} AS blooms FROM vd GROUP BY doc_id),
la AS (SELECT doc_id, count(*) FILTER (status = 'skipped') AS skipped_calls FROM cl GROUP BY doc_id), lo AS (SELECT doc_id, round(CAST(avg(CAST(latency_seconds AS DECIMAL(18, 3))) AS DOUBLE), 2) AS latency_per_call FROM ok GROUP BY doc_id),
rb AS (SELECT doc_id, CAST(coalesce(total_pages, total_units) AS BIGINT) AS total_pages, total_units AS pages_extracted, round(total_units / CAST(coalesce(total_pages, total_units) AS DOUBLE), 3) AS parse_success_rate, avg_chars AS avg_chars_per_page,
  scan_suspected, chunk_strategy, total_chunks, round(con / CAST(total_chunks AS DOUBLE), 3) AS conceptual_ratio,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('total_raw_mcqs', 'valid_mcqs', 'schema_rejected', 'quality_rejected', 'skipped_calls'))},
  round(1 - coalesce(schema_rejected, 0) / CAST(greatest(coalesce(total_raw_mcqs, 0), 1) AS DOUBLE), 3) AS schema_pass_rate, coalesce(round(valid_mcqs / CAST(total_raw_mcqs AS DOUBLE), 3), 0.0) AS content_pass_rate, coalesce(latency_per_call, 0.0) AS latency_per_call,
  coalesce(blooms, '') AS bloom_dist, coalesce(ct_s, '') AS chunk_type_counts, coalesce(pc_s, '') AS provider_call_counts, coalesce(rr_s, '') AS reject_reason_counts
  FROM fi JOIN pf USING (doc_id) JOIN ca USING (doc_id) LEFT JOIN va USING (doc_id) LEFT JOIN la USING (doc_id) LEFT JOIN lo USING (doc_id) LEFT JOIN ct USING (doc_id) LEFT JOIN pc USING (doc_id) LEFT JOIN rr USING (doc_id))"""


def _robustness(spark, sf_dir):
    src = view(spark, sf_dir, "page_src")
    files = spark.sql(_FILE.replace("page_src", "{page_src}"), page_src=src)
    chunks = chunking.numbered(chunking.build_chunks(chunking.groups_by_title(src)))
    checked = questions.validated(view(spark, sf_dir, "mcq")).withColumn("doc_id", F.concat(F.lit("src"), (F.col("ord") % 20).cast("string")))
    calls = view(spark, sf_dir, "call_log").withColumn("doc_id", F.concat(F.lit("src"), (F.col("event_id") % 25).cast("string")))
    calls = calls.withColumn("status", F.when(F.col("event_id") % 17 == 0, "skipped").otherwise(F.col("status")))
    return reports.robustness(files, profile.with_page_columns(src), chunks, checked, calls)


@register("robustness", f"{_ROBUST} SELECT * FROM rb")
def robustness(spark, sf_dir):
    rows = _robustness(spark, sf_dir)
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return rows.select(*[text(c) if t.startswith("map") else c for c, t in rows.dtypes])


_PERCENT = lambda c: f"CAST(round({c} * 100) AS DECIMAL(12, 0)) || '%'"
_COLUMNS = (
    ("File", "doc_id", -38), ("Pages", "pages_extracted || '/' || total_pages", 9), ("Parse%", _PERCENT("parse_success_rate"), 7), ("Strategy", "chunk_strategy", -12),
    ("Chunks", "CAST(total_chunks AS VARCHAR)", 6), ("Cncpt%", _PERCENT("conceptual_ratio"), 7), ("MCQs", "CAST(valid_mcqs AS VARCHAR)", 5), ("Schema%", _PERCENT("schema_pass_rate"), 8),
    ("Valid%", _PERCENT("content_pass_rate"), 7), ("Lat/call", "CAST(round(latency_per_call, 1) AS DECIMAL(12, 1)) || 's'", 9),
)
_PAD = lambda x, w: f"lpad({x}, {w}, ' ')" if w > 0 else f"rpad({x}, {-w}, ' ')"
_HEAD = " || ' ' || ".join(_PAD(f"'{h}'", w) for h, _, w in _COLUMNS)
_LINE = " || ' ' || ".join(_PAD(x, w) for _, x, w in _COLUMNS)


@register(
    "robustness_table",
    f"""{_ROBUST} SELECT 0 AS ord, {_HEAD} AS line UNION ALL SELECT 1, repeat('─', {sum(abs(w) for _, _, w in _COLUMNS) + len(_COLUMNS) - 1})
UNION ALL SELECT CAST(row_number() OVER (ORDER BY doc_id) + 1 AS INT), {_LINE} FROM rb""",
)
def robustness_table(spark, sf_dir):
    return reports.robustness_table(_robustness(spark, sf_dir))


@register(
    "page_log",
    f"WITH {sql_view('page_src')} SELECT doc_id, page_num AS ord, rpad(CAST(page_num AS VARCHAR), 7, ' ') || rpad(substr(title, 1, 40), 43, ' ') || length(text) AS line FROM page_src",
)
def page_log(spark, sf_dir):
    return reports.page_log(view(spark, sf_dir, "page_src"))


@register(
    "chunk_log",
    f"""WITH {sql_view('page_src')}, {_TITLED}, {_CHUNKS.replace('{src}', 'titled')}, nm AS (SELECT *, format('chunk_{{:03d}}', row_number() OVER (PARTITION BY doc_id ORDER BY grp)) AS chunk_id FROM c)
SELECT doc_id, CAST(grp AS BIGINT) AS ord, rpad(chunk_id, 13, ' ') || rpad(substr(topic, 1, 33), 36, ' ') || rpad(CASE WHEN len(pages) <= 4 THEN '[' || array_to_string(pages, ', ') || ']' ELSE '[' || pages[1] || '..' || pages[-1] || '](' || len(pages) || 'p)' END, 17, ' ') || length(text) AS line FROM nm
UNION ALL SELECT doc_id, max(grp) + 1, 'Avg chars/chunk: ' || CAST(round(avg(length(text))) AS BIGINT) FROM nm GROUP BY doc_id""",
)
def chunk_log(spark, sf_dir):
    return reports.chunk_log(chunking.numbered(chunking.build_chunks(chunking.groups_by_title(view(spark, sf_dir, "page_src")))))


_SHOWN = ("question", "A", "B", "C", "D", "answer", "explanation")


@register(
    "export_json",
    f"WITH {MCQ} SELECT doc_id, count(*) AS n, md5('[' || string_agg(CAST(to_json(struct_pack({', '.join(f'{c} := {c}' for c in _SHOWN)})) AS VARCHAR), ',' ORDER BY ord) || ']') AS json_md5 FROM mcq GROUP BY doc_id",
)
def export_json(spark, sf_dir):
    return exports.json_arrays(view(spark, sf_dir, "mcq"), list(_SHOWN)).select("doc_id", "n", F.md5("content").alias("json_md5"))


@register("export_workbooks", f"WITH {MCQ}, {_PREP} SELECT doc_id, count(*) AS n FROM pe WHERE error IS NULL GROUP BY doc_id")
def export_workbooks(spark, sf_dir):
    rows = questions.prepared(view(spark, sf_dir, "mcq")).where("error IS NULL").drop("error")
    return exports.kahoot_workbooks(rows).where("length(content) > 0").select("doc_id", "n")


@register(
    "question_budget",
    f"""WITH {sql_view('page_src')}, i AS (SELECT doc_id, 1 AS grp, true AS whole, count(*) AS n FROM page_src GROUP BY doc_id UNION ALL SELECT doc_id, CAST((page_num - 1) // 4 + 1 AS INT), false, count(*) FROM page_src GROUP BY ALL)
SELECT doc_id, grp, whole, CAST(q AS INT) AS n_questions, CAST(CASE WHEN whole THEN least(4096, q * 600 + 500) ELSE 1536 END AS INT) AS max_tokens FROM (SELECT *, CASE WHEN whole THEN least(greatest(2, n // 12), 5) ELSE 1 END AS q FROM i)""",
)
def question_budget(spark, sf_dir):
    pages = view(spark, sf_dir, "page_src")
    chunks = chunking.whole_doc_chunks(pages).unionByName(chunking.build_chunks(chunking.groups_fixed(pages, 4)), allowMissingColumns=True)
    return generation.with_budget(chunks, 4).select("doc_id", "grp", F.coalesce("is_whole_doc", F.lit(False)).alias("whole"), "n_questions", "max_tokens")


def _saved(spark, sf_dir):
    """Each brand's units, edges, and a chain of neighbours, as one text of JSON."""
    u, e = view(spark, sf_dir, "ku"), view(spark, sf_dir, "ku_edge")
    nxt = u.select("doc_id", (F.col("ord") - 1).alias("ord"), F.col("ku_id").alias("next"))
    units = u.join(nxt, ["doc_id", "ord"], "left").groupBy("doc_id").agg(
        F.collect_list(F.struct("ku_id", "concept", "owner_concept", "type", "content")).alias("kus"),
        F.map_from_entries(F.collect_list(F.when(F.col("next").isNotNull(), F.struct("ku_id", F.array("next"))))).alias("ku_graph"),
    )
    edges = e.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), "relation")).alias("ku_edges"))
    return units.join(edges, "doc_id", "left").select("doc_id", F.to_json(F.struct("kus", "ku_graph", "ku_edges")).alias("graph"))


@register(
    "saved_links",
    f"""WITH {KU}, {EDGE}, b AS (SELECT doc_id, a, b, relation FROM ku_edge UNION ALL SELECT doc_id, b, a, relation FROM ku_edge), g AS (SELECT k.doc_id, k.ku_id AS a, n.ku_id AS b FROM ku k JOIN ku n ON n.doc_id = k.doc_id AND n.ord = k.ord + 1)
SELECT * FROM b UNION ALL SELECT g.doc_id, g.a, g.b, NULL FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = g.doc_id AND b.a = g.a AND b.b = g.b)""",
)
def saved_links(spark, sf_dir):
    return graph.rehydrated(_saved(spark, sf_dir))[2]


@register("saved_members", f"WITH {KU} SELECT DISTINCT doc_id, concept, ku_id FROM (SELECT doc_id, ku_id, unnest([owner_concept, concept]) AS concept FROM ku) WHERE concept <> ''")
def saved_members(spark, sf_dir):
    return graph.rehydrated(_saved(spark, sf_dir))[1]
