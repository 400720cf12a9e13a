"""DuckDB statements that state independently what the registered queries must return."""

from __future__ import annotations

from linecensus.functions import languages as L
from linecensus.sources import tables as T


def _values(rows) -> str:
    def literal(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


_LANG = f"""
lang(lang_key, language, line_tok, block_start, block_end) AS (VALUES {_values(r[:5] for r in L.LANGUAGES)}),
ext(ext, lang_key) AS (VALUES {_values(L.EXTENSIONS)}),
fname(name, lang_key) AS (VALUES {_values(L.FILENAMES)})"""

_NAMES = T.SPECIAL_NAMES + [f"f.{e}" for e, _ in L.EXTENSIONS]


def _detect(source: str) -> str:
    """Adds name, stem, ext_of and language to a relation with a `path`."""
    return f"""(
SELECT p.*, coalesce(lf.language, le.language, 'Unknown') AS language
FROM (SELECT *, CASE WHEN has_ext THEN regexp_extract(name, '^(.+)[.]([^.]*)$', 1) ELSE name END AS stem,
             CASE WHEN has_ext THEN regexp_extract(name, '^(.+)[.]([^.]*)$', 2) END AS ext_of
      FROM (SELECT *, regexp_matches(name, '^.+[.][^.]*$') AS has_ext
            FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM {source}))) p
LEFT JOIN fname f ON lower(p.stem) = f.name LEFT JOIN lang lf ON lf.lang_key = f.lang_key
LEFT JOIN ext e ON lower(p.ext_of) = e.ext LEFT JOIN lang le ON le.lang_key = e.lang_key)"""


_EVENT_PATHS = f"""
names(i, file) AS (VALUES {_values(enumerate(_NAMES))}),
event_paths AS (
SELECT 'u' || user_id || '/' || folder || '/e' || event_id || '/' || file AS path,
       CAST(round(value * 100) AS BIGINT) AS size, CAST(floor(epoch(ts)) AS BIGINT) AS mtime,
       user_id, folder, file
FROM (SELECT *, CASE WHEN event_id % 23 = 0 THEN '.cache' ELSE event_type END AS folder FROM events)
JOIN names ON i = event_id % {len(_NAMES)})"""

_CORPUS = f"""
pick(pick, ext) AS (VALUES {_values(enumerate(T.CORPUS_EXTENSIONS))}),
corpus_files AS (
SELECT 'corpus/' || source || '/doc_' || doc_id || '.' || p.ext AS path,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x, k:
    CASE WHEN (k-1) % 11 = 6 THEN coalesce(block_start, '*') || ' ' || x
         WHEN (k-1) % 11 = 8 THEN x || ' ' || coalesce(block_end, '*')
         WHEN (k-1) % 11 = 10 THEN coalesce(block_start, '*') || ' ' || x || ' ' || coalesce(block_end, '*')
         WHEN (k-1) % 7 = 3 THEN '  '
         WHEN (k-1) % 5 = 0 THEN '  ' || coalesce(line_tok, '') || ' ' || x
         ELSE x END), chr(10)) AS content
FROM documents JOIN pick p ON p.pick = doc_id % {len(T.CORPUS_EXTENSIONS)}
JOIN ext e ON e.ext = p.ext JOIN lang USING (lang_key)),
corpus AS (SELECT path, language, content, strlen(content) AS size FROM {_detect('corpus_files')})"""

_HTML = f"""
html_files AS (SELECT 'pages/' || page_id || '.html' AS path, replace(html, '><', '>' || chr(10) || '<') AS content FROM pages),
html_corpus AS (SELECT path, language, content, strlen(content) AS size FROM {_detect('html_files')})"""

_WS = "' ' || chr(9) || chr(13)"


def _classified(source: str) -> str:
    """lines, states and classified over a relation path, language, content, size."""
    return f"""
raw_lines AS (
SELECT path, language, i - 1 AS line_no, raw FROM (
  SELECT path, language, len(arr) AS n, unnest(arr) AS raw, generate_subscripts(arr, 1) AS i
  FROM (SELECT path, language, string_split(content, chr(10)) AS arr FROM {source}))
WHERE NOT (i = n AND raw = '')),
trimmed AS (
SELECT l.*, ltrim(raw, {_WS}) AS r, line_tok AS lc, block_start AS bs, block_end AS be
FROM raw_lines l JOIN lang USING (language)),
events_of AS (
SELECT *, CASE WHEN r = '' OR bs IS NULL THEN NULL WHEN contains(r, be) THEN false
               WHEN starts_with(r, bs) THEN true END AS event FROM trimmed),
states AS (
SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_block FROM events_of),
ends AS (
SELECT *, CASE WHEN bs IS NULL THEN NULL
  WHEN in_block THEN nullif(strpos(r, be), 0) - 1 + length(be)
  WHEN starts_with(r, bs) THEN length(bs) + length(be)
    + coalesce(nullif(strpos(substr(r, length(bs) + 1), be), 0), nullif(strpos(r, be), 0)) - 1 END AS e
FROM states),
tails AS (SELECT *, ltrim(substr(r, e + 1), {_WS}) AS tail FROM ends),
classified AS (
SELECT path, language, line_no, raw, in_block, CASE
  WHEN r = '' THEN 'blank'
  WHEN bs IS NOT NULL AND (in_block OR starts_with(r, bs)) THEN
    CASE WHEN e IS NULL OR tail = '' OR coalesce(starts_with(tail, lc), false) THEN 'comment' ELSE 'code' END
  WHEN bs IS NOT NULL AND contains(r, bs) THEN 'code'
  WHEN coalesce(starts_with(r, lc), false) THEN 'comment'
  ELSE 'code' END AS cls
FROM tails),
file_stats AS (
SELECT f.path, f.language, count(c.cls) AS lines, count(*) FILTER (c.cls = 'code') AS code,
  count(*) FILTER (c.cls = 'comment') AS comments, count(*) FILTER (c.cls = 'blank') AS blanks,
  max(f.size)::BIGINT AS bytes
FROM {source} f LEFT JOIN classified c USING (path) GROUP BY f.path, f.language),
language_stats AS (
SELECT language AS name, count(*) AS files, sum(lines)::BIGINT AS lines, sum(code)::BIGINT AS code,
  sum(comments)::BIGINT AS comments, sum(blanks)::BIGINT AS blanks, sum(bytes)::BIGINT AS bytes
FROM file_stats GROUP BY language),
total AS (
SELECT sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines, sum(code)::BIGINT AS code,
  sum(comments)::BIGINT AS comments, sum(blanks)::BIGINT AS blanks, sum(bytes)::BIGINT AS bytes
FROM language_stats)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


_CORPUS_ALL = _with(_LANG, _CORPUS, _classified("corpus"))
_HTML_ALL = _with(_LANG, _HTML, _classified("html_corpus"))
_PATHS_ALL = _with(_LANG, _EVENT_PATHS)


def _snapshot(name: str, condition: str) -> str:
    return f"""
{name} AS (
SELECT 'u' || user_id || '/' || event_type || '.rs' AS path,
  CAST(round(arg_max(value, event_id) * 100) AS BIGINT) AS size,
  CAST(floor(epoch(arg_max(ts, event_id))) AS BIGINT) AS mtime
FROM events WHERE {condition} GROUP BY user_id, event_type)"""


_SNAPS = _with(
    _snapshot("snap_old", f"ts < TIMESTAMP '{T.SNAPSHOT_DAY}' AND user_id % 19 <> 5"),
    _snapshot("snap_new", "user_id % 17 <> 3"),
    """
probe AS (
SELECT n.path, n.size, n.mtime, coalesce(o.size = n.size AND o.mtime = n.mtime, false) AS hit,
  CASE WHEN o.size = n.size AND o.mtime = n.mtime THEN o.size % 100 END AS cached_lines
FROM snap_new n LEFT JOIN snap_old o USING (path))""",
)

_STATS = "lines, code, comments, blanks, bytes"
_IGNORED = """(folder = 'error' OR (user_id::VARCHAR LIKE '2%' AND folder = 'click')
  OR (user_id % 5 = 0 AND folder = 'view')
  OR (file LIKE '%.md' AND NOT (user_id::VARCHAR LIKE '1%' AND file = 'f.md') AND user_id % 5 <> 0)
  OR regexp_full_match(file, 'f[.]t.ml') OR regexp_matches(file, '[.][ch]$'))"""
_EXCLUDED = """(file LIKE '%.js' OR folder = 'view' OR path LIKE 'u1/%' OR file IN ('f.ts', 'f.css'))"""

_TABLE_ROW = "format(' {:<20} {:>10} {:>10} {:>10} {:>10} {:>10}'"
_FILE_ROW = "format(' {:<50} {:<15} {:>10} {:>10}'"
_FILE_LINES = f"""
SELECT unnest(['', repeat('=', 100), {_FILE_ROW}, 'File', 'Language', 'Lines', 'Code'), repeat('-', 100), repeat('=', 100)]) AS line
UNION ALL SELECT {_FILE_ROW}, CASE WHEN strlen(path) > 48 THEN '...' || right(path, 45) ELSE path END,
  language, lines, code) FROM file_stats"""


def _json_object(pad: str, fields: dict[str, str]) -> str:
    parts = ", ".join(f"'{pad}  \"{k}\": ' || {fields[k]}" for k in sorted(fields))
    return f"'{{' || chr(10) || array_to_string([{parts}], ',' || chr(10)) || chr(10) || '{pad}}}'"


_LANG_JSON = _json_object(
    "    ",
    {"name": "'\"' || name || '\"'", **{k: k for k in ["files", *_STATS.split(", ")]}},
)
_FILE_JSON = _json_object(
    "    ",
    {"path": "'\"' || path || '\"'", "language": "'\"' || language || '\"'",
     **{k: k for k in _STATS.split(", ")}},
)
_TOTAL_JSON = _json_object(
    "  ",
    {"elapsed_ms": "0", "error_count": "0", "total_files": "files", "total_lines": "lines",
     "total_code": "code", "total_comments": "comments", "total_blanks": "blanks", "total_bytes": "bytes"},
)


def oracle_sql() -> dict[str, str]:
    language_stats = f"{_CORPUS_ALL} SELECT * FROM language_stats"
    file_stats = f"{_CORPUS_ALL} SELECT * FROM file_stats"
    missing = f"""{_PATHS_ALL}, d AS {_detect('event_paths')}
SELECT path, path || ': No such file or directory (os error 2)' AS message FROM d WHERE language <> 'Unknown'"""
    return {
        "path_parts": f"{_PATHS_ALL}, d AS {_detect('event_paths')} SELECT path, name, stem, ext_of AS ext FROM d",
        "detect_language": f"{_PATHS_ALL}, d AS {_detect('event_paths')} SELECT path, language FROM d",
        "detect_language_counts": f"{_PATHS_ALL}, d AS {_detect('event_paths')} SELECT language, count(*) AS files FROM d GROUP BY language",
        "is_code_file": f"{_PATHS_ALL}, d AS {_detect('event_paths')} SELECT path FROM d WHERE language <> 'Unknown'",
        "language_filter_files": f"{_PATHS_ALL}, d AS {_detect('event_paths')} SELECT path, language FROM d WHERE language IN ('Rust', 'C++')",
        "comment_syntax": f"{_PATHS_ALL}, d AS {_detect('event_paths')} SELECT path, language, line_tok, block_start, block_end FROM d JOIN lang USING (language)",
        "display_name": f"{_with(_LANG)} SELECT l.lang_key, language AS display_name, count(d.doc_id) AS documents FROM lang l LEFT JOIN (SELECT doc_id, ext.lang_key FROM documents JOIN (VALUES {_values(enumerate(T.CORPUS_EXTENSIONS))}) p(pick, ext) ON pick = doc_id % {len(T.CORPUS_EXTENSIONS)} JOIN ext ON ext.ext = p.ext) d ON d.lang_key = l.lang_key GROUP BY ALL",
        "hidden_filter": f"{_PATHS_ALL} SELECT path FROM event_paths WHERE NOT regexp_matches(path, '(^|/)[.]')",
        "ignore_rules": f"{_PATHS_ALL} SELECT path FROM event_paths WHERE NOT {_IGNORED}",
        "exclude_globs": f"{_PATHS_ALL} SELECT path FROM event_paths WHERE NOT {_EXCLUDED}",
        "split_lines": f"{_CORPUS_ALL} SELECT path, line_no, raw FROM raw_lines",
        "line_split_counts": f"{_CORPUS_ALL} SELECT path, lines FROM file_stats",
        "count_newlines": f"{_CORPUS_ALL} SELECT path, length(content) - length(replace(content, chr(10), '')) AS newlines FROM corpus",
        "blank_lines": f"{_CORPUS_ALL} SELECT path, blanks FROM file_stats",
        "ltrim_ws": f"{_CORPUS_ALL} SELECT path, line_no, r AS trimmed FROM trimmed",
        "find_token": f"{_CORPUS_ALL} SELECT path, line_no, CASE WHEN strpos(raw, be) > 0 THEN strlen(left(raw, strpos(raw, be) - 1)) END AS position FROM trimmed",
        "fast_stats": f"{_CORPUS_ALL} SELECT path, language, lines, lines - blanks AS code, 0::BIGINT AS comments, blanks, bytes FROM file_stats",
        "classify_lines_html": f"{_HTML_ALL} SELECT path, line_no, cls FROM classified",
        "classify_lines_corpus": f"{_CORPUS_ALL} SELECT path, line_no, cls FROM classified",
        "block_state": f"{_CORPUS_ALL} SELECT path, line_no, in_block FROM classified",
        "split_lines_pieces": f"{_CORPUS_ALL} SELECT path, line_no, raw FROM raw_lines",
        "classify_lines_pieces": f"{_CORPUS_ALL} SELECT path, line_no, cls FROM classified",
        "block_state_pieces": f"{_CORPUS_ALL} SELECT path, line_no, in_block FROM classified",
        "classify_lines_tree": f"{_CORPUS_ALL} SELECT path, line_no, cls FROM classified WHERE language <> 'Unknown'",
        "file_stats": file_stats,
        "language_stats": language_stats,
        "language_stats_html": f"{_HTML_ALL} SELECT * FROM language_stats",
        "grand_total_rollup": f"{_CORPUS_ALL} SELECT name, 0 AS is_total, files, {_STATS} FROM language_stats UNION ALL SELECT 'Total', 1, files, {_STATS} FROM total",
        "merge_stats": f"{_with(_LANG, _CORPUS, _HTML, 'both_files AS (FROM corpus UNION ALL FROM html_corpus)', _classified('both_files'))} SELECT * FROM language_stats",
        "langs_by_code": f"{language_stats} ORDER BY code DESC, name",
        "langs_by_files": f"{language_stats} ORDER BY files DESC, name",
        "files_by_path": f"{file_stats} ORDER BY path",
        "files_by_size": f"{_PATHS_ALL} SELECT path, size FROM event_paths ORDER BY size DESC, path",
        "cache_probe": f"{_SNAPS} SELECT * FROM probe",
        "cache_misses": f"{_SNAPS} SELECT path, size, mtime FROM probe WHERE NOT hit",
        "cache_hit_rate": f"{_SNAPS} SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (NOT hit) AS new_files, round(count(*) FILTER (hit) * 100.0 / count(*), 4) AS hit_rate FROM probe",
        "cache_upsert": f"""{_SNAPS}, both_snaps AS (SELECT *, 1 AS cached_at FROM snap_new UNION ALL SELECT *, 0 FROM snap_old WHERE path NOT IN (SELECT path FROM snap_new))
SELECT path, size, mtime, 'Rust' AS language, size % 100 AS lines, size AS bytes, cached_at::BIGINT AS cached_at FROM both_snaps""",
        "cache_cleanup": f"{_SNAPS} SELECT path, size, mtime FROM snap_old WHERE path IN (SELECT path FROM snap_new)",
        "cache_validate": f"{_SNAPS} SELECT path, size, mtime FROM snap_old WHERE size % 5 <> 0 AND size % 7 <> 0",
        "cache_modes": f"{_SNAPS} SELECT m AS mode, count(*) FILTER (hit AND m = 'reuse') AS hits, count(*) FILTER (NOT (hit AND m = 'reuse')) AS misses FROM probe, (VALUES ('reuse'), ('fresh'), ('rebuild')) v(m) GROUP BY m",
        "combine_results": f"{_SNAPS} SELECT path, size, mtime, size % 100 + CASE WHEN hit THEN 1000 ELSE 0 END AS lines FROM probe",
        "root_id": "SELECT DISTINCT 'corpus/' || source AS root, md5('corpus/' || source) AS root_id FROM documents",
        "summary": f"{_CORPUS_ALL} SELECT files AS total_files, lines AS total_lines, code AS total_code, comments AS total_comments, blanks AS total_blanks, bytes AS total_bytes, 2000::BIGINT AS elapsed_ms, 3::BIGINT AS error_count, round(files / 2.0, 4) AS files_per_sec, round(lines / 2.0, 4) AS lines_per_sec FROM total",
        "report_table": f"""{_CORPUS_ALL} SELECT unnest(['', repeat('=', 80), {_TABLE_ROW}, 'Language', 'Files', 'Lines', 'Code', 'Comments', 'Blanks'), repeat('-', 80), repeat('-', 80), '', '']) AS line
UNION ALL SELECT {_TABLE_ROW}, name, files, lines, code, comments, blanks) FROM language_stats
UNION ALL SELECT unnest([{_TABLE_ROW}, 'Total', files, lines, code, comments, blanks), repeat('=', 80), ' Statistics completed in 0.000s (inf files/s, inf lines/s)']) FROM total""",
        "report_files": f"{_CORPUS_ALL} {_FILE_LINES}",
        "report_full": f"""{_CORPUS_ALL}, {_EVENT_PATHS}, d AS {_detect('event_paths')},
errors AS (SELECT path, row_number() OVER (ORDER BY path) AS n, path || ': No such file or directory (os error 2)' AS message FROM d WHERE language <> 'Unknown'),
n_errors AS (SELECT count(*) AS n FROM errors)
SELECT unnest(['', repeat('=', 80), {_TABLE_ROW}, 'Language', 'Files', 'Lines', 'Code', 'Comments', 'Blanks'), repeat('-', 80), repeat('-', 80), '', '', '']) AS line
UNION ALL SELECT {_TABLE_ROW}, name, files, lines, code, comments, blanks) FROM language_stats
UNION ALL SELECT unnest([{_TABLE_ROW}, 'Total', files, lines, code, comments, blanks), repeat('=', 80),
  format(' Statistics completed in 2.000s ({{:.0f}} files/s, {{:.0f}} lines/s)', round_even(files / 2.0, 0), round_even(lines / 2.0, 0))]) FROM total
UNION ALL SELECT unnest([format(' {{}} errors occurred:', n), format('   ... and {{}} more', n - 5)]) FROM n_errors
UNION ALL SELECT format('   {{}}. {{}}', n, message) FROM errors WHERE n <= 5
UNION ALL {_FILE_LINES}""",
        "report_csv": f"""{_CORPUS_ALL} SELECT unnest(['Type,Name,Files,Lines,Code,Comments,Blanks,Bytes', '', 'File,Language,Lines,Code,Comments,Blanks,Bytes']) AS line
UNION ALL SELECT concat_ws(',', 'Language', name, files, {_STATS}) FROM language_stats
UNION ALL SELECT concat_ws(',', 'Total', 'Total', files, {_STATS}) FROM total
UNION ALL SELECT concat_ws(',', path, language, {_STATS}) FROM file_stats""",
        "report_json": f"""{_CORPUS_ALL} SELECT '{{' || chr(10) || '  "summary": ' || {_TOTAL_JSON} || ',' || chr(10) || '  "languages": [' AS line FROM total
UNION ALL SELECT '    ' || {_LANG_JSON} || CASE WHEN row_number() OVER (ORDER BY code, name DESC) = 1 THEN '' ELSE ',' END FROM language_stats
UNION ALL SELECT unnest(['  ],', '  "files": [', '  ]', '}}'])
UNION ALL SELECT '    ' || {_FILE_JSON} || CASE WHEN path = (SELECT max(path) FROM file_stats) THEN '' ELSE ',' END FROM file_stats""",
        "error_sample": f"{missing} ORDER BY path LIMIT 5",
        "error_count": f"SELECT count(*) AS error_count FROM ({missing})",
        "scan_tree": f"{_CORPUS_ALL} SELECT path, language, size FROM corpus",
        "report_csv_tables": file_stats,
        "report_json_tables": file_stats,
        "tree_source": f"{_CORPUS_ALL} SELECT path, language, size, md5(content) AS digest FROM corpus",
        "read_content": f"{_CORPUS_ALL} SELECT path, strlen(content) AS size, 0::BIGINT AS \"offset\", md5(content) AS digest FROM corpus",
        "analyze_tree": language_stats,
        "analyze_tree_rerun": f"""{_CORPUS_ALL}, n AS (SELECT count(*) AS files_in_all FROM corpus)
SELECT l.*, 'first' AS run, 0::BIGINT AS hits, files_in_all AS misses FROM language_stats l, n
UNION ALL SELECT l.*, 'second', files_in_all, 0 FROM language_stats l, n""",
        "analyze_tree_pieces": language_stats,
        "analyze_tree_long_lines": language_stats,
        "scan_single": f"{_CORPUS_ALL} SELECT regexp_extract(path, '[^/]*$') AS path, language, size FROM corpus WHERE path = (SELECT min(path) FROM corpus)",
        "follow_links": f"""{_CORPUS_ALL}, linked AS (
SELECT path, regexp_extract(path, '^corpus/([^/]*)/', 1) AS folder, language, size FROM corpus),
first_two AS (SELECT DISTINCT folder FROM linked ORDER BY folder LIMIT 2)
SELECT path, language, size, followed FROM corpus, (VALUES (false), (true)) AS f(followed)
UNION ALL SELECT 'link-' || substr(path, 8), language, size, true FROM linked WHERE folder IN (FROM first_two)""",
        "cache_sink": f"{_CORPUS_ALL} SELECT path, bytes AS size, language, lines FROM file_stats",
        "running_totals": f"""{_CORPUS_ALL}, edited AS (
SELECT language AS name, {_STATS}, regexp_extract(path, 'doc_([0-9]+)', 1)::BIGINT % 3 = 0 AS emptied FROM file_stats),
after AS (
SELECT name, if(emptied, 0, lines) AS lines, if(emptied, 0, code) AS code, if(emptied, 0, comments) AS comments,
  if(emptied, 0, blanks) AS blanks, if(emptied, 0, bytes) AS bytes FROM edited
UNION ALL SELECT 'Rust', 1, 1, 0, 0, 2 FROM edited WHERE emptied)
SELECT l.*, 'first' AS run FROM language_stats l
UNION ALL SELECT name, count(*), sum(lines)::BIGINT, sum(code)::BIGINT, sum(comments)::BIGINT, sum(blanks)::BIGINT,
  sum(bytes)::BIGINT, 'second' FROM after GROUP BY name""",
        "scan_tree_filtered": f"""{_CORPUS_ALL}, named AS (SELECT *, regexp_extract(path, '[^/]*$') AS file,
  regexp_extract(path, 'src([0-9]+)/', 1)::INT AS folder FROM corpus)
SELECT path, language, size FROM named WHERE file NOT LIKE '%.css'
AND NOT (folder % 3 = 0 AND (file LIKE '%.py' OR file LIKE 'doc_1%') AND file NOT LIKE 'doc_12%')""",
    }
