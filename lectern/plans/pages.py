"""Queries on pages: quality, layout, profiles and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.vocab import INSTRUCTIONAL_TOPICS, LINE_END, SPACE, STRUCTURAL_TOPICS
from lectern.operators import chunking, profile

from .views import sql_view, table, view

# DuckDB spellings of the text kernel
strip = lambda x: f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
words = lambda x: f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"
lines = lambda x: f"regexp_split_to_array({x}, '{LINE_END}')"
collapse = lambda x: f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"
word_set = lambda x: f"list_distinct({words(f'lower({x})')})"
jaccard = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"
pipes = lambda x: f"length({x}) - length(replace({x}, '|', ''))"
IMAGE = r"!\[[^\n]*?\]\([^\n]*?\)"
markdown = lambda x: strip(f"regexp_replace(regexp_replace({x}, '{IMAGE}', '', 'g'), '[*_`#~]', '', 'g')")
topic = lambda x: strip(f"regexp_replace(lower({x}), '[*_`#~]', '', 'g')")
title_norm = lambda x: strip(f"regexp_replace({strip(f'''lower(regexp_replace({x}, '[*_`#~]', '', 'g'))''')}, '^(\\d+[.)]\\s*|chapter\\s+\\d+\\s*[:\\-]?\\s*)', '')")
any_of = lambda x, keys: "(" + " OR ".join(f"contains({x}, '{k}')" for k in keys) + ")"
chunk_kind = lambda t, x: f"CASE WHEN length({x}) < 150 THEN 'stub' WHEN length({x}) <= 3000 AND {any_of(topic(t), STRUCTURAL_TOPICS)} THEN 'structural' WHEN {any_of(topic(t), INSTRUCTIONAL_TOPICS)} THEN 'instructional' ELSE 'conceptual' END"
quality = lambda x: f"""CASE WHEN length({strip(x)}) < 50 THEN 'low_text'
  WHEN len({words(x)}) >= 15 AND CAST(len(list_filter({words(x)}, lambda w: regexp_full_match(w, '\\p{{L}}'))) AS DOUBLE) / len({words(x)}) > 0.25 THEN 'garbled'
  WHEN len({words(x)}) > 0 AND CAST(list_sum(list_transform({words(x)}, lambda w: length(w))) AS DOUBLE) / len({words(x)}) < 2 THEN 'noisy' ELSE 'good' END"""  # noqa: E731
_FORMULA = X.FORMULA.replace("'", "''")
_FLAGS = f"""SELECT *, len(list_filter(ls, lambda x: CASE WHEN {pipes('x')} >= 2 THEN true ELSE regexp_matches({strip('x')}, '\\S+\\s{{2,}}\\S+\\s{{2,}}\\S+')
    AND len(regexp_split_to_array({strip('x')}, '\\s{{2,}}')) >= 3 AND len(list_filter(regexp_split_to_array({strip('x')}, '\\s{{2,}}'), lambda t: length(t) <= 18)) >= 2 END)) >= 2
    OR regexp_matches(text, '(?m)^\\s*\\|.+\\|\\s*$\\n^\\s*\\|[\\s:\\-|]+\\|\\s*$') AS has_table,
  regexp_matches(text, '{_FORMULA}') AS has_formula,
  len(list_filter(ls, lambda x: regexp_matches({markdown('x')}, '(?i)^\\s*(figure|fig\\.|table|hinh|hinh\\s+\\d+|bang|bang\\s+\\d+|bảng|hình)([^\\p{{L}}\\p{{N}}_]|$)'))) > 0 AS has_caption,
  len(list_filter(ls, lambda x: length(x) >= 40 AND regexp_matches(x, '[a-zA-Z0-9)]\\s{{6,}}[A-Z0-9]'))) >= 3 AS has_columns
  FROM (SELECT *, list_filter(list_transform({lines('text')}, lambda x: regexp_replace(x, '{SPACE}+$', '')), lambda x: x <> '') AS ls FROM {{src}})"""


def _page_table(src: str) -> str:
    return f"""fl AS ({_FLAGS.replace('{src}', src)}), pg AS (SELECT * EXCLUDE (ls), has_table OR has_formula OR (has_caption AND has_image) OR has_columns AS layout_sensitive,
  length(text) AS char_count, {quality('text')} AS text_quality FROM fl)"""


QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_TITLED = f"""t AS (SELECT *, {title_norm('title')} AS t FROM page_src),
g1 AS (SELECT *, CASE WHEN t IS NOT DISTINCT FROM lag(t) OVER (PARTITION BY doc_id ORDER BY page_num) AND row_number() OVER (PARTITION BY doc_id ORDER BY page_num) > 1 THEN 0 ELSE 1 END AS nw FROM t),
g2 AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY page_num) AS run FROM g1),
g3 AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY page_num) - 1) // 6 AS part FROM g2),
titled AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY run, part) AS grp FROM g3)"""
_CHUNKS = """c AS (SELECT doc_id, CAST(grp AS INT) AS grp, min_by(title, page_num) AS topic, list(page_num ORDER BY page_num) AS pages,
  string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page_num) AS text, bool_or(has_image) AS has_image FROM {src} GROUP BY doc_id, grp)"""
_OUT = f"""SELECT doc_id, format('chunk_{{:03d}}', row_number() OVER (PARTITION BY doc_id ORDER BY grp)) AS chunk_id, {chunk_kind('topic', 'text')} AS chunk_type, topic,
  array_to_string(pages, ',') AS pages, md5(text) AS text_md5, has_image FROM c"""


def _digest(chunks):
    return chunks.select(
        "doc_id", "chunk_id", "chunk_type", "topic", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.md5("text").alias("text_md5"), "has_image"
    )


@register(
    "chunk_report",
    f"WITH {sql_view('page_src')}, {_TITLED}, {_CHUNKS.replace('{src}', 'titled')} SELECT {chunk_kind('topic', 'text')} AS chunk_type, count(*) AS chunks, round(avg(length(text)), 2) AS avg_chars FROM c GROUP BY 1",
)
def chunk_report(spark, sf_dir):
    chunks = chunking.numbered(chunking.build_chunks(chunking.groups_by_title(view(spark, sf_dir, "page_src"))))
    return chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.length("text")), 2).alias("avg_chars"))


@register("chunks_by_title", f"WITH {sql_view('page_src')}, {_TITLED}, {_CHUNKS.replace('{src}', 'titled')} {_OUT}")
def chunks_by_title(spark, sf_dir):
    return _digest(chunking.numbered(chunking.build_chunks(chunking.groups_by_title(view(spark, sf_dir, "page_src")))))


@register(
    "chunks_fixed",
    f"WITH {sql_view('page_src')}, fx AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1) // 4 + 1 AS grp FROM page_src), {_CHUNKS.replace('{src}', 'fx')} {_OUT}",
)
def chunks_fixed(spark, sf_dir):
    return _digest(chunking.numbered(chunking.build_chunks(chunking.groups_fixed(view(spark, sf_dir, "page_src"), 4))))


_LAPPED = f"""ov AS (
  SELECT doc_id, page_num, {jaccard('w1', 'w')} AS s1, {jaccard('list_distinct(list_concat(coalesce(w2, []), w1))', 'w')} AS s2, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS rn
  FROM (SELECT doc_id, page_num, w, lag(w, 1) OVER d AS w1, lag(w, 2) OVER d AS w2 FROM (SELECT doc_id, page_num, {word_set("coalesce(text, '')")} AS w FROM {{src}}) WINDOW d AS (PARTITION BY doc_id ORDER BY page_num))
), fold AS (
  SELECT doc_id, page_num, rn, 1 AS len, 1 AS grp FROM ov WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.page_num, o.rn, CASE WHEN f.len < 6 AND coalesce(CASE WHEN f.len = 1 THEN s1 ELSE s2 END, 0) >= 0.12 THEN f.len + 1 ELSE 1 END,
    f.grp + CASE WHEN f.len < 6 AND coalesce(CASE WHEN f.len = 1 THEN s1 ELSE s2 END, 0) >= 0.12 THEN 0 ELSE 1 END
  FROM fold f JOIN ov o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1
), lapped AS (SELECT p.*, f.grp FROM {{src}} p JOIN fold f USING (doc_id, page_num))"""


@register("chunks_by_overlap", f"WITH RECURSIVE {sql_view('page_near')}, {_LAPPED.replace('{src}', 'page_near')}, {_CHUNKS.replace('{src}', 'lapped')} {_OUT}")
def chunks_by_overlap(spark, sf_dir):
    return _digest(chunking.numbered(chunking.build_chunks(chunking.groups_by_overlap(view(spark, sf_dir, "page_near")))))


@register(
    "chunks_auto",
    f"""WITH RECURSIVE {sql_view('page_src')}, {_TITLED}, {_LAPPED.replace('{src}', 'page_src')},
hd AS (SELECT doc_id, grp, min_by(title, page_num) AS topic FROM titled GROUP BY ALL), sh AS (SELECT doc_id, CAST(count(DISTINCT topic) AS DOUBLE) / count(*) AS r, count(*) AS n FROM hd GROUP BY doc_id),
au AS (SELECT t.doc_id, t.page_num, t.title, t.text, t.has_image, CASE WHEN r < 0.4 OR (r > 0.85 AND n > 15) THEN l.grp ELSE t.grp END AS grp
  FROM titled t JOIN sh USING (doc_id) JOIN lapped l ON l.doc_id = t.doc_id AND l.page_num = t.page_num), {_CHUNKS.replace('{src}', 'au')} {_OUT}""",
)
def chunks_auto(spark, sf_dir):
    return _digest(chunking.numbered(chunking.build_chunks(chunking.auto_groups(view(spark, sf_dir, "page_src")))))


@register(
    "chunks_whole_doc",
    f"""WITH {sql_view('page_src')}, p AS (SELECT *, {strip('text')} AS st FROM page_src), c AS (
  SELECT doc_id, 1 AS grp, min_by(title, page_num) AS topic, list(page_num ORDER BY page_num) AS pages,
    string_agg('[' || title || ']' || chr(10) || st, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_num) AS text, bool_or(has_image) AS has_image
  FROM p WHERE st <> '' GROUP BY doc_id) {_OUT}""",
)
def chunks_whole_doc(spark, sf_dir):
    return _digest(chunking.numbered(chunking.whole_doc_chunks(view(spark, sf_dir, "page_src"))))


@register(
    "dedup_pages",
    f"""WITH RECURSIVE {sql_view('page_near')}, o AS (SELECT doc_id, page_num, {word_set(strip("coalesce(text, '')"))} AS w FROM page_near),
f AS (SELECT doc_id, page_num, [w] AS last, true AS kept FROM o WHERE page_num = 1
  UNION ALL SELECT doc_id, page_num, CASE WHEN twin THEN last ELSE list_concat(last, [w])[-3:] END, NOT twin FROM (
    SELECT o.doc_id, o.page_num, o.w, f.last, len(list_filter(f.last, lambda s: {jaccard('o.w', 's')} > 0.95)) > 0 AS twin FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_num = f.page_num + 1))
SELECT doc_id, page_num FROM f WHERE kept""",
)
def dedup_pages(spark, sf_dir):
    return chunking.dedup_pages(view(spark, sf_dir, "page_near")).select("doc_id", "page_num")


# Weak images: what leads a document grows until it says more; later chunks are judged alone.
_WEAK = lambda image, text: f"""({image} AND length({text}) < 200 AND (len({_SAID(text)}) = 0 OR CAST(len(list_filter({_SAID(text)}, lambda x: starts_with(x, '![') OR contains(x, 'intentionally omitted'))) AS DOUBLE) / len({_SAID(text)}) > 0.6))"""
_SAID = lambda text: f"list_filter(list_transform({lines(text)}, lambda x: {strip('x')}), lambda x: x <> '')"
_PIPELINE = f"""dd AS (SELECT p.* FROM page_near p JOIN ({{dedup}}) k ON k.doc_id = p.doc_id AND k.page_num = p.page_num),
{_TITLED.replace('page_src', 'dd')}, {_LAPPED.replace('{src}', 'dd')}, hd AS (SELECT doc_id, grp, min_by(title, page_num) AS topic FROM titled GROUP BY ALL), sh AS (SELECT doc_id, CAST(count(DISTINCT topic) AS DOUBLE) / count(*) AS r, count(*) AS n FROM hd GROUP BY doc_id),
au AS (SELECT t.doc_id, t.page_num, t.title, t.text, t.has_image, CASE WHEN r < 0.4 OR (r > 0.85 AND n > 15) THEN l.grp ELSE t.grp END AS grp
  FROM titled t JOIN sh USING (doc_id) JOIN lapped l ON l.doc_id = t.doc_id AND l.page_num = t.page_num), {_CHUNKS.replace('{src}', 'au').replace('c AS', 'c0 AS')},
c1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS k, {_WEAK('has_image', 'text')} AS weak FROM c0),
wk AS (SELECT doc_id, k, 0 AS g, weak AS open, CASE WHEN weak THEN text END AS lead, has_image AS image FROM c1 WHERE k = 1
  UNION ALL SELECT c1.doc_id, c1.k, CASE WHEN open OR c1.weak THEN g ELSE g + 1 END, open AND {_WEAK('(image OR c1.has_image)', "(lead || chr(10) || chr(10) || c1.text)")}, CASE WHEN open THEN lead || chr(10) || chr(10) || c1.text END, image OR c1.has_image
  FROM wk JOIN c1 ON c1.doc_id = wk.doc_id AND c1.k = wk.k + 1),
lx AS (SELECT doc_id, coalesce(min(k) FILTER (NOT open), max(k)) AS head FROM wk GROUP BY doc_id),
c AS (SELECT doc_id, g AS grp, arg_min(topic, CASE WHEN k = head THEN 0 ELSE k END) AS topic, flatten(list(pages ORDER BY k)) AS pages, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text, bool_or(has_image) AS has_image
  FROM c1 JOIN wk USING (doc_id, k) JOIN lx USING (doc_id) GROUP BY doc_id, g)"""


@register("chunk_pipeline", f"WITH RECURSIVE {sql_view('page_near')}, {_PIPELINE.replace('{dedup}', SQL['dedup_pages'])} {_OUT}")
def chunk_pipeline(spark, sf_dir):
    return _digest(chunking.chunk_pages(view(spark, sf_dir, "page_near")))


@register(
    "page_layout",
    f"WITH {sql_view('page_src')}, {_page_table('page_src')} SELECT doc_id, page_num, has_table, has_formula, has_caption, has_columns, layout_sensitive, text_quality, CAST(char_count AS INT) AS char_count FROM pg",
)
def page_layout(spark, sf_dir):
    return profile.with_page_columns(view(spark, sf_dir, "page_src")).select(
        "doc_id", "page_num", "has_table", "has_formula", "has_caption", "has_columns", "layout_sensitive", "text_quality", "char_count"
    )


_RATIOS = ("low_text", "image", "table", "formula", "column", "layout_sensitive", "garbled")
_SCAN = "(ocr_units > 0 OR (low_text_units / n >= 0.6 AND image_units / n >= 0.5))"


@register(
    "document_profile",
    f"""WITH {sql_view('page_src')}, {_page_table('page_src')}, a AS (
  SELECT doc_id, count(*) AS total_units, CAST(count(*) AS DOUBLE) AS n, CAST(sum(char_count) AS BIGINT) AS total_chars, CAST(min(char_count) AS INT) AS min_chars, CAST(max(char_count) AS INT) AS max_chars,
    count(*) FILTER (char_count < 120) AS low_text_units, count(*) FILTER (has_image) AS image_units, count(*) FILTER (ocr_used) AS ocr_units,
    count(*) FILTER (parser IN ('pdfplumber', 'pytesseract')) AS fallback_units, count(*) FILTER (has_table) AS table_units, count(*) FILTER (has_formula) AS formula_units,
    count(*) FILTER (has_columns) AS column_units, count(*) FILTER (layout_sensitive) AS layout_sensitive_units, count(*) FILTER (text_quality = 'garbled') AS garbled_units FROM pg GROUP BY doc_id)
SELECT doc_id, total_units, total_chars, round(total_chars / n, 1) AS avg_chars, min_chars, max_chars, low_text_units, image_units, ocr_units, fallback_units, table_units, formula_units, column_units, layout_sensitive_units,
  {', '.join(f'round({k}_units / n, 3) AS {k}_ratio' for k in _RATIOS)}, {_SCAN} AS scan_suspected,
  CASE WHEN {_SCAN} THEN 'ocr_review' WHEN low_text_units / n > 0.3 THEN 'low_text_review' WHEN image_units / n > 0.4 THEN 'vision_or_image_review' WHEN total_chars <= 60000 THEN 'whole_doc' ELSE 'native_text' END AS recommended_strategy,
  CASE WHEN total_chars <= 60000 THEN 'whole_doc' WHEN {_SCAN} OR low_text_units / n > 0.5 OR garbled_units / n > 0.3 OR total_chars / n < 300 THEN 'overlap'
    WHEN table_units / n > 0.3 OR layout_sensitive_units / n > 0.4 THEN 'overlap' WHEN column_units / n > 0.4 THEN 'title' ELSE 'auto' END AS chunk_strategy FROM a""",
)
def document_profile(spark, sf_dir):
    return profile.document_profile(profile.with_page_columns(view(spark, sf_dir, "page_src")))


@register(
    "parser_histogram",
    f"WITH {sql_view('page_src')} SELECT doc_id, string_agg(parser || '=' || n, ',' ORDER BY parser) AS parsers FROM (SELECT doc_id, parser, count(*) AS n FROM page_src GROUP BY ALL) GROUP BY doc_id",
)
def parser_histogram(spark, sf_dir):
    h = profile.histogram(view(spark, sf_dir, "page_src"), "doc_id", "parser")
    return h.select("doc_id", F.array_join(F.transform(F.map_entries("parser_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("parsers"))


_BARE = lambda x: rf"""regexp_replace({x}, '^[.,;:!?"''()\[\]{{}}]+|[.,;:!?"''()\[\]{{}}]+$', '', 'g')"""
_METRICS = rf"""m AS (SELECT *, len(w) AS wc, len(list_filter(w, lambda x: length({_BARE('x')}) = 1 AND regexp_full_match(x, '\p{{L}}+'))) AS single,
  len(list_filter({lines('text')}, lambda x: {pipes('x')} >= 2)) AS pl,
  list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: {strip('s')}), lambda s: s <> '') AS se FROM (SELECT *, {words('text')} AS w FROM pg)),
mm AS (SELECT doc_id, page_num, CAST(char_count AS INT) AS char_count, CAST(wc AS INT) AS word_count, CASE WHEN wc > 0 THEN round(CAST(single AS DOUBLE) / wc, 3) ELSE 0.0 END AS single_char_ratio, has_table, has_image, text_quality,
  has_table AND pl >= 2 AS table_readable, NOT ocr_used AND has_image AND char_count < 80 AS is_image_only,
  CASE WHEN wc >= 10 THEN CASE WHEN len(se) > 0 THEN round(CAST(len(list_filter(se, lambda s: len({words('s')}) >= 5)) AS DOUBLE) / len(se), 3) ELSE 0.0 END END AS coherence_score FROM m)"""


@register(
    "page_metrics",
    f"WITH {sql_view('page_src')}, {_page_table('page_src')}, {_METRICS} SELECT doc_id, page_num, char_count, word_count, single_char_ratio, table_readable, is_image_only, coherence_score FROM mm",
)
def page_metrics(spark, sf_dir):
    m = profile.page_metrics(profile.with_page_columns(view(spark, sf_dir, "page_src")))
    return m.select("doc_id", "page_num", "char_count", "word_count", "single_char_ratio", "table_readable", "is_image_only", "coherence_score")


@register(
    "parse_quality",
    f"""WITH {sql_view('page_src')}, {_page_table('page_src')}, {_METRICS} SELECT doc_id, count(*) AS extracted_pages, round(CAST(sum(char_count) AS DOUBLE) / count(*), 1) AS avg_chars_per_page, count(*) FILTER (has_table) AS table_pages,
  count(*) FILTER (has_table AND table_readable) AS table_readable, count(*) FILTER (has_table AND NOT table_readable) AS table_flat, count(*) FILTER (has_image) AS image_pages, count(*) FILTER (is_image_only) AS image_only_pages,
  count(*) FILTER (text_quality = 'garbled') AS garbled_pages, round(CAST(count(*) FILTER (text_quality = 'garbled') AS DOUBLE) / count(*), 3) AS garbled_ratio, coalesce(round(avg(CAST(coherence_score AS DECIMAL(18, 3))), 3), 0.0) AS avg_layout_coherence FROM mm GROUP BY doc_id""",
)
def parse_quality(spark, sf_dir):
    return profile.parse_quality(profile.page_metrics(profile.with_page_columns(view(spark, sf_dir, "page_src"))))


@register(
    "titles",
    f"""WITH l AS (SELECT doc_id, text, list_transform({lines('text')}, lambda x: {strip('x')}) AS ls FROM documents),
h AS (SELECT *, list_filter(list_transform(list_filter(ls, lambda x: starts_with(x, '#')), lambda x: {strip("regexp_replace(x, '^#+', '')")}), lambda x: NOT starts_with(x, '![') AND length(x) > 3 AND length(x) < 200) AS hs,
  list_filter(ls, lambda x: length(x) > 3 AND NOT regexp_matches(x, '^(-|\\*|\\||!\\[|#)')) AS ps,
  list_filter(list_transform(list_filter(ls, lambda x: x <> '' AND NOT regexp_matches(x, '^(!\\[|-|\\*|\\||#)')), lambda x: {strip("regexp_replace(x, '[*_`#]', '', 'g')")}), lambda x: length(x) > 3) AS fs FROM l)
SELECT doc_id, coalesce(hs[1], substr(ps[1], 1, 200)) AS title, substr({collapse('ps[1]')}, 1, 80) AS clean, coalesce(substr(fs[1], 1, 80), 'Section') AS first_line, {title_norm('ps[1]')} AS norm FROM h""",
)
def titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", X.own_lines("text").alias("own"))
    plain = F.get(F.filter("own", lambda x: (F.length(x) > 3) & ~x.rlike(r"^(-|\*|\||!\[|#)")), F.lit(0))
    d = d.select("doc_id", X.title_of("text", F.col("own")).alias("title"), plain.alias("plain"), X.first_meaningful_line("text", F.col("own")).alias("first_line"))
    return d.select("doc_id", "title", X.clean_title("plain").alias("clean"), "first_line", X.normalize_title("plain").alias("norm"))


@register(
    "section_labels",
    f"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\\n'), 1) AS page_num FROM documents)
SELECT doc_id, CAST(page_num AS INT) AS page_num, CASE WHEN length({strip('t')}) < 30 THEN 'low_text' WHEN len({words('t')}) < 8 THEN 'sparse' ELSE 'good' END AS text_quality,
  CASE WHEN length({strip('t')}) < 80 THEN 'short_section' ELSE '' END AS warnings FROM l WHERE length({strip('t')}) >= 30""",
)
def section_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t")).where(F.length(X.strip("t")) >= 30)
    return rows.select("doc_id", (F.col("pos") + 1).alias("page_num"), X.section_quality("t").alias("text_quality"), F.array_join(X.section_warnings("t"), ",").alias("warnings"))


@register(
    "prompt_text",
    f"""SELECT page_id, md5({strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '!\\[([^\\]]*)\\]\\([^)]*\\)', '[Image: \\1]', 'g'), '(?m)^#{1,3}\\s+.+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS clean FROM pages""",
)
def prompt_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.prompt_text("html")).alias("clean"))


@register(
    "packed_paragraphs",
    """WITH RECURSIVE d AS (SELECT doc_id, text, regexp_split_to_array(text, '\\n') AS ps FROM documents WHERE length(text) > 1500),
f AS (SELECT doc_id, ps, 1 AS i, 0 AS part, length(ps[1]) AS n, ps[1] AS cur, CAST(NULL AS VARCHAR) AS done FROM d
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN n + length(ps[i + 1]) > 1500 THEN part + 1 ELSE part END, CASE WHEN n + length(ps[i + 1]) > 1500 THEN length(ps[i + 1]) ELSE n + length(ps[i + 1]) END,
    CASE WHEN n + length(ps[i + 1]) > 1500 THEN ps[i + 1] ELSE cur || chr(10) || ps[i + 1] END, NULL FROM f WHERE i < len(ps))
SELECT doc_id, part, md5(max_by(cur, i)) AS text_md5 FROM f GROUP BY doc_id, part UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 1500""",
)
def packed_paragraphs(spark, sf_dir):
    out = chunking.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1500, "\n", "\n")
    return out.select("doc_id", "part", F.md5("part_text").alias("text_md5"))


_LIST = r"^(\d+[.)]|[-*•])\s+"


@register(
    "layout_blocks",
    f"""WITH {sql_view('block')}, b AS (SELECT *, (x0 + x1) / 2 AS cx, median(font_size) OVER (PARTITION BY doc_id) AS base FROM block),
k AS (SELECT *, CASE WHEN count(*) FILTER (cx < 600 * 0.45) OVER (PARTITION BY doc_id) >= 2 AND count(*) FILTER (cx > 600 * 0.55) OVER (PARTITION BY doc_id) >= 2 AND cx >= 300 THEN 1 ELSE 0 END AS column_index FROM b)
SELECT doc_id, block_no, x0, y0, CASE WHEN y1 < 800 * 0.08 THEN 'header' WHEN y0 > 800 * 0.92 THEN 'footer' WHEN regexp_matches(text, '(?i)^\\s*(figure|fig\\.|table)\\b') THEN 'caption'
  WHEN regexp_matches(text, '{_FORMULA}') THEN 'formula' WHEN regexp_matches(text, '{_LIST}') THEN 'list' WHEN font_size >= base * 1.45 THEN 'title' WHEN is_bold OR font_size >= base * 1.18 THEN 'heading' ELSE 'text' END AS block_type, column_index,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY column_index, y0, x0, block_no, text, font_size) - 1 AS INT) AS reading_order FROM k""",
)
def layout_blocks(spark, sf_dir):
    from lectern.operators.layout import page_blocks

    out = page_blocks(view(spark, sf_dir, "block"), ["doc_id"], 600, 800)
    return out.select("doc_id", "block_no", "x0", "y0", "block_type", "column_index", "reading_order")
