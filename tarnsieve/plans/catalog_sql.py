"""DuckDB SQL of the deduplication engine's queries, written from their definitions."""

from __future__ import annotations

_LIB = r"""
WITH files0 AS (SELECT doc_id, text, concat('/lib/', source, '/', lang) AS dir,
    concat('doc', CAST(doc_id AS VARCHAR), CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' WHEN 2 THEN '.jpg'
      WHEN 3 THEN '.mp4' WHEN 4 THEN '.docx' WHEN 5 THEN '.log' ELSE '.csv' END) AS name,
    CAST(strlen(text) AS BIGINT) AS size, CAST(1700000000 AS DOUBLE) + doc_id * CAST(60.5 AS DOUBLE) AS mtime, md5(text) AS fh,
    md5(CASE WHEN strlen(text) > 256 THEN array_slice(encode(text), 1, 256)
      || array_slice(encode(text), greatest(1, strlen(text) - 255), strlen(text)) ELSE encode(text) END) AS ph
  FROM documents),
cat AS (SELECT *, concat(dir, '/', name) AS path, lower(regexp_extract(name, '^\.*[^.](?:[\s\S]*?)(\.[^.]*)$', 1)) AS ext FROM files0),
lib AS (SELECT *, CASE WHEN ext = '.jpg' THEN 'image' WHEN ext = '.mp4' THEN 'video' ELSE 'doc' END AS category FROM cat
  WHERE ext IN ('.txt', '.pdf', '.docx', '.csv', '.jpg', '.mp4')),
dups AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY fh) AS n FROM lib) t WHERE n > 1),
acts AS (SELECT path FROM lib WHERE doc_id % 4 = 1),
live AS (SELECT d.*, CASE WHEN a.path IS NULL THEN 0 ELSE 1 END AS deleted FROM dups d LEFT JOIN acts a ON a.path = d.path),
rules AS (SELECT * FROM (VALUES ('/lib/src1', true, 0), ('/lib/src2/en', false, 1), ('/lib/src1/fr', false, 5),
  ('/lib/src3', false, 2), ('/lib/src2', true, 3)) t(rpath, recursive, rnk)),
prev AS (SELECT path, size, CASE WHEN doc_id % 5 = 0 THEN mtime - 1 ELSE mtime END AS mtime, ph, fh FROM lib WHERE doc_id % 10 <> 3),
seen AS (SELECT path, size, mtime FROM lib WHERE doc_id % 11 <> 0)
"""

_NATURAL = r"""list_transform(string_split(regexp_replace(name, '(\d+)', '~\1~', 'g'), '~'), lambda t, i: struct_pack(
  l := CASE WHEN i % 2 = 0 THEN length(regexp_replace(t, '^0+(.)', '\1')) ELSE 0 END,
  s := CASE WHEN i % 2 = 0 THEN regexp_replace(t, '^0+(.)', '\1') ELSE lower(t) END))"""


def _plan(live: str) -> str:
    """The removal plan over the live files of groups."""
    return rf"""
, cur AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY fh) AS left_n FROM ({live}) q) t WHERE left_n > 1),
rr AS (SELECT d.path AS p, r.rnk, ROW_NUMBER() OVER (PARTITION BY d.path ORDER BY CASE WHEN d.dir = r.rpath THEN 0 ELSE 1 END, length(r.rpath) DESC) AS k
  FROM cur d JOIN rules r ON d.dir = r.rpath OR (r.recursive AND starts_with(d.dir, concat(r.rpath, '/')))),
ranked AS (SELECT d.*, COALESCE(CAST(rr.rnk AS DOUBLE), CAST('Infinity' AS DOUBLE)) AS rk FROM cur d LEFT JOIN rr ON rr.p = d.path AND rr.k = 1),
t1 AS (SELECT *, MIN(rk) OVER (PARTITION BY fh) AS top FROM ranked),
t2 AS (SELECT *, SUM(CASE WHEN rk = top THEN 1 ELSE 0 END) OVER (PARTITION BY fh) AS nt,
  ROW_NUMBER() OVER (PARTITION BY fh, CASE WHEN rk = top THEN 1 ELSE 0 END ORDER BY length(name) DESC, {_NATURAL} DESC, path ASC) AS pos FROM t1),
plan AS (SELECT fh, path, size, CASE WHEN rk <> top THEN 'lower' ELSE 'tie' END AS why FROM t2 WHERE rk <> top OR (nt > 1 AND pos = 1))
"""


_ALL, _LIVE = _plan("SELECT * FROM dups"), _plan("SELECT * FROM live WHERE deleted = 0")
_SIZE = r"CASE WHEN size < 1024 THEN concat(size, ' B') ELSE concat(printf('%.1f', CAST(size AS DOUBLE) / 1024), ' KB') END"
_TIME = r"strftime(make_timestamp(CAST(round({} * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S')"
_GROUPS = "SELECT fh, COUNT(*) AS n, arg_min(size, path) AS rep, CAST(SUM(size) AS BIGINT) AS tot FROM lib GROUP BY fh HAVING COUNT(*) > 1"

_BODIES = {
    "S1_catalog_scan": "SELECT path, dir, name, ext, category, size FROM lib",
    "J1_size_candidates": "SELECT path, size FROM lib WHERE size IN (SELECT size FROM lib GROUP BY size HAVING COUNT(*) > 1)",
    "J2_partial_candidates": "SELECT path, size, ph FROM lib WHERE (size, ph) IN (SELECT (size, ph) FROM lib GROUP BY size, ph HAVING COUNT(*) > 1)",
    "A3_exact_groups": f"SELECT fh, n, rep, tot, CAST(rep * (n - 1) AS BIGINT) AS wasted FROM ({_GROUPS}) g",
    "A4_count_files": "SELECT COUNT(*) AS total_files FROM lib",
    "F2_null_predicates": """SELECT path, ph IS NULL AS needs_partial, fh IS NULL AND ph IS NOT NULL AS may_need_full, fh IS NOT NULL AS hashed
        FROM (SELECT path, CASE WHEN doc_id % 15 <> 0 THEN ph END AS ph, CASE WHEN doc_id % 3 <> 0 THEN fh END AS fh FROM lib) t""",
    "F3_lookup": "SELECT path, size FROM lib WHERE path = '/lib/src0/en/doc0.txt' UNION ALL SELECT path, size FROM lib WHERE name = 'doc14.txt'",
    "A5_members": "SELECT fh, path, ROW_NUMBER() OVER (PARTITION BY fh ORDER BY path) AS pos FROM dups",
    "A7_reclaimable": f"SELECT CAST(COALESCE(SUM(rep * (n - 1)), 0) AS BIGINT) AS reclaimable FROM ({_GROUPS}) g",
    "O2_group_order": f"SELECT fh, ROW_NUMBER() OVER (ORDER BY tot DESC, fh) AS pos FROM ({_GROUPS}) g",
    "F5_search": "SELECT fh, path FROM lib WHERE contains(lower(concat(name, ' ', path)), 'oc12')",
    "F5_group_visibility": """SELECT fh, path, hit, MAX(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY fh) = 1 AS group_visible
        FROM (SELECT *, contains(lower(concat(name, ' ', path)), 'src1/') AS hit FROM dups) t""",
    "F6_highlight": """SELECT dir, dir = (SELECT MIN(dir) FROM lib WHERE contains(lower(dir), 'src1')) AS is_first
        FROM (SELECT DISTINCT dir FROM lib) t WHERE contains(lower(dir), 'src1')""",
    "A8_P1_can_delete": "SELECT fh, path, deleted = 0 AND SUM(CASE WHEN deleted = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY fh) > 1 AS can_delete FROM live",
    "A9_folders": "SELECT DISTINCT dir FROM (SELECT dir, COUNT(*) OVER (PARTITION BY fh) AS c FROM live WHERE deleted = 0) t WHERE c >= 2",
    "J5_folder_ranks": """SELECT f.dir, (SELECT arg_min(r.rnk, CASE WHEN f.dir = r.rpath THEN -1000000 ELSE -length(r.rpath) END) FROM rules r
        WHERE f.dir = r.rpath OR (r.recursive AND starts_with(f.dir, concat(r.rpath, '/')))) AS rank FROM (SELECT DISTINCT dir FROM lib) f""",
    "W2_suggest_delete": _ALL + "SELECT fh, path, size, why FROM plan",
    "F7_suggest_live": _LIVE + "SELECT fh, path, why FROM plan",
    "A12_plan_totals": _ALL + "SELECT COUNT(*) AS n_files, CAST(COALESCE(SUM(size), 0) AS BIGINT) AS total_size FROM plan",
    "O6_plan_preview": _ALL + f"""SELECT path, (SELECT greatest(COUNT(*) - 20, 0) FROM plan) AS n_more
        FROM (SELECT p.path, p.fh, p.why, g.tot FROM plan p JOIN ({_GROUPS}) g ON g.fh = p.fh ORDER BY tot DESC, fh, why, path LIMIT 20) t""",
    "O3_sorted_folders": """SELECT dir, ROW_NUMBER() OVER (ORDER BY dir) AS pos
        FROM (SELECT DISTINCT dir FROM (SELECT dir, COUNT(*) OVER (PARTITION BY fh) AS c FROM live WHERE deleted = 0) t WHERE c >= 2) f""",
    "J6_O4_prefill": """SELECT dir, COALESCE(recursive, false) AS recursive, ROW_NUMBER() OVER (ORDER BY CASE WHEN rnk IS NULL THEN 1 ELSE 0 END, rnk, lower(dir), dir) AS pos
        FROM (SELECT DISTINCT dir FROM dups) f LEFT JOIN rules r ON r.rpath = f.dir""",
    "W4_W5_rank_numbers": """SELECT dir AS path, starts_with(dir, '/lib/src1/') AS recursive,
          CAST(ROW_NUMBER() OVER (ORDER BY NOT starts_with(dir, '/lib/src1/'), place) - 1 AS INTEGER) AS rank,
          CAST(ROW_NUMBER() OVER (ORDER BY NOT starts_with(dir, '/lib/src1/'), place) AS INTEGER) AS shown
        FROM (SELECT dir, CASE WHEN fr AND before > 0 THEN p - 1 WHEN fr THEN p
            ELSE COALESCE(MIN(CASE WHEN NOT fr THEN p END) OVER (ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), total + 1) - 1 END AS place
          FROM (SELECT dir, fr, p, COUNT(*) OVER () AS total, SUM(CASE WHEN fr THEN 0 ELSE 1 END) OVER (ORDER BY p) AS before
            FROM (SELECT dir, ends_with(dir, '/fr') AS fr, ROW_NUMBER() OVER (ORDER BY dir) AS p FROM (SELECT DISTINCT dir FROM lib) d) x) y) z""",
    "M4_incremental_merge": """SELECT s.path, s.size, s.mtime, CASE WHEN p.size = s.size AND p.mtime = s.mtime THEN p.ph END AS ph,
        CASE WHEN p.size = s.size AND p.mtime = s.mtime THEN p.fh END AS fh, p.path IS NULL AS is_new FROM seen s LEFT JOIN prev p ON p.path = s.path""",
    "M2_swept_rows": "SELECT path FROM lib WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.path = lib.path)",
    "A13_removed": "SELECT COUNT(*) AS removed FROM lib WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.path = lib.path)",
    "J3_new_rows": "SELECT path FROM lib WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.path = lib.path)",
    "M6_error_merge": """SELECT f.path, COALESCE(h.error, f.error) AS error FROM (SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'old' END AS error FROM lib) f
        LEFT JOIN (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'new' END AS error FROM lib WHERE doc_id % 2 = 0) h ON h.path = f.path""",
    "M3_last_wins": """SELECT path, size FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY path ORDER BY seq DESC) AS k
        FROM (SELECT path, size, doc_id AS seq FROM lib UNION ALL SELECT path, size + 1, doc_id + 100000 FROM lib WHERE doc_id % 6 = 0) b) t WHERE k = 1""",
    "M7_rules_upsert": """SELECT COALESCE(nw.rpath, old.rpath) AS rpath, COALESCE(nw.recursive, old.recursive) AS recursive, CAST(COALESCE(nw.rnk, old.rnk) AS INTEGER) AS rnk
        FROM (SELECT rpath, true AS recursive, ROW_NUMBER() OVER (ORDER BY rpath) - 1 AS rnk FROM (SELECT DISTINCT regexp_extract(dir, '^(/lib/[^/]*)/', 1) AS rpath FROM lib) s) old
        FULL OUTER JOIN (SELECT rpath, false AS recursive, ROW_NUMBER() OVER (ORDER BY rpath) - 1 AS rnk FROM (SELECT DISTINCT dir AS rpath FROM lib WHERE ends_with(dir, '/fr')
          UNION SELECT DISTINCT regexp_extract(dir, '^(/lib/[^/]*)/', 1) FROM lib WHERE ends_with(regexp_extract(dir, '^(/lib/[^/]*)/', 1), '1')) e) nw ON nw.rpath = old.rpath""",
    "F1_F3_catalog_lookup": """SELECT path, '/lib' AS root, size, fh FROM lib WHERE doc_id % 2 = 0
        UNION ALL SELECT path, CASE WHEN doc_id % 2 = 0 THEN '/lib' ELSE '/other' END, size, fh FROM lib WHERE path = (SELECT MAX(path) FROM lib)""",
    "M2_M4_catalog_update": """SELECT path, '/lib' AS root, CASE WHEN doc_id % 5 = 0 THEN mtime - 1 ELSE mtime END AS mtime,
          CASE WHEN doc_id % 5 <> 0 THEN ph END AS ph, CASE WHEN doc_id % 5 <> 0 THEN fh END AS fh FROM lib WHERE doc_id % 3 <> 0
        UNION ALL SELECT path, '/other', mtime, ph, fh FROM lib WHERE doc_id % 3 = 0 AND doc_id % 2 = 1""",
    "A5_J7_member_pages": """SELECT fh, (pos - 1) // 2 AS page, n, total, string_agg(path, '|' ORDER BY path) AS paths
        FROM (SELECT fh, path, n, CAST(SUM(size) OVER (PARTITION BY fh) AS BIGINT) AS total, ROW_NUMBER() OVER (PARTITION BY fh ORDER BY path) AS pos FROM dups) t GROUP BY ALL""",
    "A14_summary": f"""SELECT '/lib' AS root, (SELECT COUNT(*) FROM lib) AS total_files, CAST(3 AS BIGINT) AS removed,
        (SELECT COUNT(*) FROM ({_GROUPS}) g) AS exact_group_count, false AS cancelled""",
    "O5_natural_order": f"SELECT path, ROW_NUMBER() OVER (ORDER BY {_NATURAL}, path) AS pos FROM lib",
    "X5_format_size": f"SELECT path, {_SIZE} AS size_text FROM lib",
    "X6_format_time": f"SELECT path, {_TIME.format('mtime')} AS time_text FROM lib",
    "X13_group_headers": f"SELECT fh, concat('Exact duplicates — ', n, ' files, ', {_SIZE.replace('size', 'rep')}, ' each') AS header FROM ({_GROUPS}) g",
    "X14_thousands": "SELECT path, format('{:,}', size * 1000) AS size_text FROM lib",
    "X15_details": f"""SELECT path, concat('Name:          ', name, chr(10), 'Folder:        ', dir, chr(10), 'Full path:     ', path, chr(10), 'Category:      ', category, chr(10),
        'Size:          ', {_SIZE}, chr(10), 'Modified:      ', {_TIME.format('mtime')}, chr(10),
        'Created (fs):  ', CASE WHEN doc_id % 2 = 0 THEN {_TIME.format('mtime')} ELSE '-' END, chr(10), chr(10),
        'Full hash:     ', CASE WHEN doc_id % 3 = 0 THEN fh ELSE '(not computed)' END, chr(10), 'Partial hash:  ', ph,
        CASE WHEN doc_id % 9 = 0 THEN concat(chr(10), chr(10), 'Warning: unreadable') ELSE '' END) AS detail FROM lib""",
    "S1_X1_X2_file_tree": """SELECT path, name, category, size, 32 AS partial_digits, 64 AS full_digits,
        COUNT(*) OVER (PARTITION BY ends) AS same_partial, COUNT(*) OVER (PARTITION BY text) AS same_full
        FROM (SELECT *, CASE WHEN strlen(text) > 65536 THEN md5(array_slice(encode(text), 1, 65536)
          || array_slice(encode(text), greatest(1, strlen(text) - 65535), strlen(text))) ELSE md5(text) END AS ends FROM lib) t""",
}

SQL = {name: _LIB + body for name, body in _BODIES.items()}
