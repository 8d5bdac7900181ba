"""DuckDB SQL of the registered queries."""

from __future__ import annotations

_FORMATS = """f(format, ext, tier, hashable, is_raw) AS (VALUES
  ('CR2','cr2',0,false,true),('CR3','cr3',0,false,true),('NEF','nef',0,false,true),('ARW','arw',0,false,true),('ORF','orf',0,false,true),
  ('RAF','raf',0,false,true),('RW2','rw2',0,false,true),('DNG','dng',0,false,true),('TIFF','tiff',1,true,false),('PNG','png',2,true,false),
  ('JPEG','jpg',3,true,false),('HEIC','heic',4,false,false),('WebP','webp',5,true,false))"""


def _signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN {x} - 18446744073709551616 ELSE {x} END AS BIGINT)"


def _bits(condition: str) -> str:
    return f"coalesce(list_sum(list_transform(range(64), lambda i: CASE WHEN {condition} THEN (1::HUGEINT << i::INTEGER) ELSE 0::HUGEINT END)), 0::HUGEINT)"


_GRID = f"""words AS (
  SELECT doc_id, text, list_transform(list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda w: w <> ''),
    lambda w: (unicode(w) * 31 + length(w)) % 72) AS cells FROM documents
), grids AS (
  SELECT doc_id, list_transform(range(72), lambda k: len(list_filter(cells, lambda c: c = k))::BIGINT) AS g FROM words
), lefts AS (
  SELECT doc_id, g, list_transform(range(64), lambda i: g[(i // 8) * 9 + i % 8 + 1]) AS l, list_transform(range(64), lambda i: g[(i // 8) * 9 + i % 8 + 2]) AS r FROM grids
), bits AS (
  SELECT doc_id, {_bits("l[i + 1] >= list_sum(l) // 64")} AS p, {_bits("l[i + 1] > r[i + 1]")} AS d FROM lefts
), hashes AS (SELECT doc_id, {_signed("p")} AS phash, {_signed("d")} AS dhash FROM bits)"""

_LISTED = f"""{_FORMATS}, listed AS (
  SELECT doc_id, doc_id + 1 AS id, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) + 1 AS source_id, n_chars AS size,
    CASE WHEN doc_id % 10 <= 5 THEN 'JPEG' WHEN doc_id % 10 = 6 THEN 'PNG' WHEN doc_id % 10 = 7 THEN 'HEIC' WHEN doc_id % 10 = 8 THEN 'CR2' ELSE 'TIFF' END AS format,
    sha256(text) AS sha256, 1700000000 + (doc_id * 7919) % 1000000 AS mtime, lang, source,
    CASE WHEN doc_id % 11 <> 0 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n_chars), '%Y-%m-%d %H:%M:%S') END AS exif_date,
    CASE WHEN doc_id % 7 <> 0 THEN lang END AS exif_camera_model
  FROM documents
), files AS (
  SELECT l.*, '/' || source || '/' || lang || '/' || doc_id || '.' || f.ext AS path, f.tier, f.hashable FROM listed l JOIN f USING (format)
)"""

_ASSETS = f"""{_GRID}, {_LISTED}, assets AS (
  SELECT a.*, CASE WHEN a.ok THEN h.phash END AS phash, CASE WHEN a.ok THEN h.dhash END AS dhash
  FROM (SELECT *, bool_or(hashable) OVER (PARTITION BY sha256) AS ok FROM files) a JOIN hashes h USING (doc_id)
)"""

_STORED = f"""{_LISTED}, dup AS (
  SELECT *, min(id) OVER (PARTITION BY sha256) AS g, count(*) OVER (PARTITION BY sha256) AS n FROM files
), members AS (SELECT dense_rank() OVER (ORDER BY g) AS group_id, id AS photo_id, * FROM dup WHERE n >= 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY tier, size DESC, mtime, id) AS rn FROM members
), best AS (SELECT group_id, id AS sot FROM ranked WHERE rn = 1
), roles AS (
  SELECT fl.*, m.group_id, b.sot = fl.id AS is_sot FROM files fl LEFT JOIN members m ON m.id = fl.id LEFT JOIN best b ON b.group_id = m.group_id
)"""

_KEYED = f"""{_ASSETS}, keyed AS (
  SELECT *, exif_date || '|' || coalesce(exif_camera_model, 'unknown') AS k FROM assets WHERE exif_date IS NOT NULL
), shared AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, count(phash) OVER (PARTITION BY k) AS hashed FROM keyed
), valid AS (
  SELECT DISTINCT a.id FROM shared a JOIN shared b ON a.k = b.k AND a.id <> b.id
  WHERE bit_count(xor(a.phash, b.phash)) <= 2 AND coalesce(bit_count(xor(a.dhash, b.dhash)) <= 2, true)
), captured AS (SELECT s.*, v.id IS NOT NULL AS validated FROM shared s LEFT JOIN valid v USING (id) WHERE n >= 2
), kept AS (SELECT * FROM captured WHERE validated OR phash IS NULL OR hashed < 2
), counted AS (
  SELECT *, min(id) OVER (PARTITION BY k) AS g, count(*) OVER (PARTITION BY k) AS m, sum(validated::INT) OVER (PARTITION BY k) AS v FROM kept
), capture AS (SELECT 2 AS phase, g AS "group", id, CASE WHEN v >= 2 THEN 2 ELSE 3 END AS confidence FROM counted WHERE m >= 2
), exact AS (
  SELECT 1 AS phase, g AS "group", id, 4 AS confidence FROM (SELECT id, min(id) OVER (PARTITION BY sha256) AS g, count(*) OVER (PARTITION BY sha256) AS n FROM assets) WHERE n >= 2
), early AS (SELECT * FROM exact UNION ALL SELECT * FROM capture)"""

_TAKEN = f"""{_LISTED}, taken AS (
  SELECT id, mtime, CASE id % 6 WHEN 0 THEN replace(exif_date, '-', ':') WHEN 1 THEN exif_date[1:10] WHEN 2 THEN exif_date || ':x' WHEN 5 THEN exif_date[1:11] || '12:-5:00' WHEN 3 THEN 'x-' || exif_date
    WHEN 4 THEN replace(exif_date, '2024', '1969') ELSE exif_date END AS taken FROM listed
), tokens AS (SELECT *, list_filter(regexp_split_to_array(taken, '\\s+'), lambda x: x <> '') AS t FROM taken)"""


def _seconds(t: str) -> str:
    d = f"list_transform(list_filter(regexp_split_to_array({t}[1], '[:-]'), lambda x: regexp_full_match(x, '[+]?[0-9]{{1,18}}')), lambda x: x::BIGINT)"
    h = f"list_transform(list_filter(regexp_split_to_array({t}[2], ':'), lambda x: regexp_full_match(x, '[+-]?[0-9]{{1,18}}')), lambda x: x::BIGINT)"
    days = f"(({d})[1] * 365 + ({d})[1] // 4 + ({d})[2] * 31 + ({d})[3])"
    return f"CASE WHEN len({t}) >= 2 AND len({d}) >= 3 AND len({h}) >= 3 THEN {days} * 86400 + ({h})[1] * 3600 + ({h})[2] * 60 + ({h})[3] END"


_PARTS = f"""{_TAKEN}, parts AS (SELECT *, regexp_split_to_array(t[1], '[:-]') AS p FROM tokens
), nums AS (SELECT *, CASE WHEN regexp_full_match(p[1], '[+]?[0-9]{{1,9}}') THEN p[1]::INT END AS y, CASE WHEN regexp_full_match(p[2], '[+]?[0-9]{{1,9}}') THEN p[2]::INT END AS m,
  CASE WHEN regexp_full_match(p[3], '[+]?[0-9]{{1,9}}') THEN p[3]::INT END AS d FROM parts
), good AS (SELECT *, coalesce(len(p) >= 3 AND y BETWEEN 1970 AND 2100 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31, false) AS ok FROM nums)"""

_STAMP = "(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(mtime))"


def _human(x: str) -> str:
    def part(k: int, unit: str) -> str:
        return f"printf('%.1f {unit}', ({x}) / {1024.0**k:.1f})"

    return f"CASE WHEN {x} < 1024 THEN ({x})::BIGINT || ' B' WHEN {x} < 1048576 THEN {part(1, 'KB')} WHEN {x} < 1073741824 THEN {part(2, 'MB')} ELSE {part(3, 'GB')} END"


_LISTING = f"""{_LISTED}, listing AS (
  SELECT id, source_id, path, size, CASE WHEN id % 17 = 0 THEN mtime - 5 WHEN id % 19 = 0 THEN mtime + 5 ELSE mtime END AS mtime FROM files WHERE id % 13 <> 0
  UNION ALL SELECT id, source_id, path || '.new.jpg', size, mtime FROM files WHERE id % 23 = 0
)"""

_PACK = """states AS (
  SELECT 'now' AS state, sha256, path, format, size FROM files
  UNION ALL SELECT 'before', CASE WHEN id % 3 = 0 THEN sha256(sha256 || '-before') ELSE sha256 END, path, format, size + CASE WHEN id % 2 = 0 THEN 7 ELSE 0 END FROM files
), plans AS (
  SELECT state, sha256, path AS source, '/pack/' || sha256[1:2] || '/' || sha256 || '.' || ext AS target, regexp_extract(path, '[^/]+$') AS original_filename, format, size
  FROM (SELECT s.*, fo.ext, row_number() OVER (PARTITION BY state, sha256 ORDER BY path) AS rn FROM states s JOIN f fo USING (format)) WHERE rn = 1
)"""

SQL = {
    "format_dim_join": f"WITH {_LISTED} SELECT id, f.format, f.ext, f.tier, f.hashable, f.is_raw FROM listed JOIN f USING (format)",
    "sha256_fingerprint": f"WITH {_LISTED} SELECT id, sha256 FROM listed",
    "ahash_dhash_words": f"WITH {_GRID} SELECT doc_id, phash, dhash FROM hashes",
    "ahash_embeddings": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l FROM embeddings WHERE len(embedding) = 64),
      m AS (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, l), lambda a, x: a + x) / 64 AS mean FROM e), b AS (SELECT vec_id, {_bits("l[i + 1] >= mean")} AS p FROM m)
      SELECT vec_id, {_signed("p")} AS phash FROM b""",
    "exact_groups": f"""WITH {_LISTED}, d AS (SELECT id, min(id) OVER (PARTITION BY sha256) AS g, count(*) OVER (PARTITION BY sha256) AS n FROM files)
      SELECT 1 AS phase, g AS "group", id, 4 AS confidence FROM d WHERE n >= 2""",
    "hash_inherit": f"""WITH {_ASSETS}, s AS (SELECT *, min(CASE WHEN hashable THEN source_id END) OVER (PARTITION BY sha256) AS since FROM assets)
      SELECT id, (CASE WHEN hashable OR since <= source_id THEN phash END)::VARCHAR AS phash, (CASE WHEN hashable OR since <= source_id THEN dhash END)::VARCHAR AS dhash FROM s""",
    "leader_per_sha": f"""WITH {_LISTED} SELECT sha256, arg_min(id, path) FILTER (hashable) AS leader_id, count(*) AS copies FROM files
      GROUP BY sha256 HAVING bool_or(hashable)""",
    "exif_key_groups": f"""WITH {_LISTED} SELECT exif_date || '|' || coalesce(exif_camera_model, 'unknown') AS exif_key, count(*) AS n, min(id) AS least_id
      FROM listed WHERE exif_date IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""",
    "exif_seconds": f"WITH {_TAKEN} SELECT id, ({_seconds('t')})::VARCHAR AS seconds FROM tokens",
    "exif_date_parts": f"""WITH {_PARTS} SELECT id, (CASE WHEN ok THEN y END)::VARCHAR AS year, (CASE WHEN ok THEN m END)::VARCHAR AS month, (CASE WHEN ok THEN d END)::VARCHAR AS day FROM good""",
    "asset_date": f"""WITH {_PARTS} SELECT id, CASE WHEN ok THEN y ELSE year({_STAMP})::INT END AS year, CASE WHEN ok THEN m ELSE month({_STAMP})::INT END AS month,
      CASE WHEN ok THEN d ELSE day({_STAMP})::INT END AS day FROM good""",
    "exif_validated_members": f"WITH {_KEYED} SELECT k AS exif_key, id, validated, hashed FROM captured",
    "exif_groups_confidence": f"WITH {_KEYED} SELECT * FROM capture",
    "hamming_within_3": f"""WITH {_ASSETS}, h AS (SELECT DISTINCT phash FROM assets WHERE phash IS NOT NULL)
      SELECT a.phash AS a, b.phash AS b, bit_count(xor(a.phash, b.phash))::INT AS distance,
        CASE WHEN bit_count(xor(a.phash, b.phash)) <= 2 THEN 3 ELSE 1 END AS confidence
      FROM h a JOIN h b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 3""",
    "accepted_edges": f"""WITH {_KEYED}, kinds AS (
        SELECT phash, dhash, exif_date, exif_camera_model, min(id) AS kind, bool_or(id NOT IN (SELECT id FROM early)) AS seeds
        FROM assets WHERE phash IS NOT NULL GROUP BY 1, 2, 3, 4
      ), timed AS (SELECT *, regexp_split_to_array(exif_date, '\\s+') AS t FROM kinds
      ), secs AS (SELECT *, {_seconds("t")} AS sec FROM timed)
      SELECT a.kind AS a, b.kind AS b, least(CASE WHEN bit_count(xor(a.phash, b.phash)) <= 2 THEN 3 ELSE 1 END, CASE WHEN bit_count(xor(a.dhash, b.dhash)) <= 2 THEN 3 ELSE 1 END) AS confidence
      FROM secs a JOIN secs b ON a.kind < b.kind AND (a.seeds OR b.seeds) AND bit_count(xor(a.phash, b.phash)) <= 3 AND bit_count(xor(a.dhash, b.dhash)) <= 3
      WHERE NOT coalesce(a.exif_camera_model = b.exif_camera_model AND a.exif_date <> b.exif_date AND abs(a.sec - b.sec) <= 60, false)""",
    "sequential_events": """SELECT a.user_id, a.event_id AS a, b.event_id AS b, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap
      FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000""",
    "components_exact_exif": f"""WITH RECURSIVE {_KEYED}, edges AS (SELECT DISTINCT "group" AS a, id AS b FROM early UNION SELECT DISTINCT id, "group" FROM early
      ), reach AS (SELECT a AS id, a AS label FROM edges UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.id)
      SELECT id, min(label) AS label FROM reach GROUP BY id""",
    "elect_sot": f"WITH {_STORED} SELECT group_id AS id, sot AS source_of_truth_id, 'Certain' AS confidence FROM best",
    "status_overview": f"""WITH {_STORED} SELECT count(*) AS photos, (SELECT count(*) FROM best) AS groups, count(*) FILTER (NOT is_sot) AS duplicates,
      count(*) FILTER (coalesce(is_sot, true)) AS "unique", sum(size)::BIGINT AS disk_bytes, coalesce(sum(size) FILTER (NOT is_sot), 0)::BIGINT AS savings_bytes FROM roles""",
    "db_stats_summary": f"""WITH {_STORED} SELECT count(DISTINCT source_id) AS sources, count(*) AS photos, (SELECT count(*) FROM best) AS groups,
      (SELECT count(DISTINCT id) FROM members JOIN best USING (group_id) WHERE id <> sot) AS duplicates FROM files""",
    "source_stats": f"WITH {_LISTED} SELECT source_id, count(*) AS photo_count, sum(size)::BIGINT AS total_size FROM listed GROUP BY source_id",
    "sources_report": f"""WITH {_LISTED}, s AS (SELECT DISTINCT source_id AS id FROM listed),
      t AS (SELECT source_id, count(*) AS n, sum(size)::BIGINT AS z FROM listed GROUP BY source_id)
      SELECT id, 'src' || (id - 1) AS name, coalesce(n, 0) AS photo_count, {_human("coalesce(z, 0)")} AS size,
        CASE WHEN id % 3 = 0 THEN 'never' ELSE strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1700000000 + id), '%Y-%m-%d %H:%M:%S') END AS last_scanned
      FROM s LEFT JOIN t ON t.source_id = s.id
      UNION ALL SELECT id + 1000, 'src' || (id - 1) || '-new', 0, '0 B', 'never' FROM s""",
    "files_report": f"""WITH {_STORED} SELECT id, regexp_extract(path, '[^/]+$') AS name, CASE WHEN source_id % 4 = 0 THEN '?' ELSE 'src' || (source_id - 1) END AS source, format,
      {_human("size")} AS size, group_id::VARCHAR AS group_id, CASE WHEN is_sot THEN 'Best Copy' WHEN NOT is_sot THEN 'Duplicate' ELSE 'Unique' END AS role, coalesce(is_sot, true) AS eligible, path FROM roles""",
    "group_listing": f"""WITH {_STORED} SELECT group_id, 'Certain' AS confidence, count(*) AS members, sum(size)::BIGINT AS total_size, max(path) FILTER (id = sot) AS best
      FROM members JOIN best USING (group_id) GROUP BY group_id""",
    "group_detail": f"""WITH {_STORED} SELECT group_id, 'Certain' AS confidence, photo_id, CASE WHEN id = sot THEN '*' ELSE '' END AS best, path, format, size, sha256
      FROM members JOIN best USING (group_id) WHERE group_id = 1""",
    "grouped_photos": f"""WITH {_STORED} SELECT group_id, 'Certain' AS confidence, photo_id, path, exif_date AS taken FROM members""",
    "metadata_present": f"WITH {_LISTED} SELECT id, exif_date IS NOT NULL OR exif_camera_model IS NOT NULL AS present FROM listed",
    "export_selection": f"WITH {_STORED} SELECT id, path FROM roles WHERE coalesce(is_sot, true)",
    "content_paths": f"WITH {_LISTED}, {_PACK} SELECT sha256, source, target, original_filename FROM plans WHERE state = 'now'",
    "export_paths": f"""WITH {_LISTED}, d AS (SELECT *, coalesce(strptime(exif_date, '%Y-%m-%d %H:%M:%S'), {_STAMP}) AS day FROM files)
      SELECT id, path AS source, '/export/' || strftime(day, '%Y/%m/%d') || '/' || doc_id || '.heic' AS target FROM d""",
    "incremental_changed": f"""WITH {_LISTING} SELECT l.path, l.mtime FROM listing l LEFT JOIN files k ON k.path = l.path WHERE l.mtime IS DISTINCT FROM k.mtime""",
    "incremental_stale": f"WITH {_LISTING} SELECT id, path FROM files WHERE path NOT IN (SELECT path FROM listing)",
    "upsert_merge": f"""WITH {_LISTING}, new AS (SELECT * FROM listing WHERE path NOT IN (SELECT path FROM files))
      SELECT f.id, coalesce(l.source_id, f.source_id) AS source_id, f.path, coalesce(l.size + 1, f.size) AS size, coalesce(l.mtime, f.mtime) AS mtime
      FROM files f LEFT JOIN listing l ON l.path = f.path
      UNION ALL SELECT (SELECT max(id) FROM files) + row_number() OVER (ORDER BY source_id, path), source_id, path, size + 1, mtime FROM new""",
    "cascade_delete_source": f"""WITH {_STORED}, gone AS (SELECT id FROM files WHERE source_id = 1), dead AS (SELECT group_id FROM best WHERE sot IN (SELECT id FROM gone)),
      kept AS (SELECT group_id, id FROM members WHERE id NOT IN (SELECT id FROM gone) AND group_id NOT IN (SELECT group_id FROM dead))
      SELECT (SELECT count(*) FROM files) - (SELECT count(*) FROM gone) AS photos, (SELECT count(DISTINCT group_id) FROM kept) AS groups, (SELECT count(*) FROM kept) AS members""",
    "invalidate_hashes": f"WITH {_LISTED} SELECT id, NULL::VARCHAR AS phash, NULL::VARCHAR AS dhash, 0::BIGINT AS mtime FROM listed",
    "manifest_replace": f"""WITH {_LISTED}, {_PACK}, inc AS (
        SELECT sha256, regexp_extract(path, '[^/]+$') AS original_filename, format, size, row_number() OVER (PARTITION BY sha256 ORDER BY id DESC) AS rn FROM files)
      SELECT sha256, original_filename, format, size FROM inc WHERE rn = 1
      UNION ALL SELECT sha256, original_filename, format, size FROM plans WHERE state = 'before' AND sha256 NOT IN (SELECT sha256 FROM inc)""",
    "manifest_cleanup": f"""WITH {_LISTED}, {_PACK}
      SELECT sha256, target, 'remove' AS action FROM plans WHERE state = 'before' AND sha256 NOT IN (SELECT sha256 FROM plans WHERE state = 'now')
      UNION ALL SELECT sha256, target, 'add' FROM plans WHERE state = 'now' AND sha256 NOT IN (SELECT sha256 FROM plans WHERE state = 'before')""",
    "human_sizes": f"""WITH {_LISTED}, z AS (SELECT id, CASE id % 4 WHEN 0 THEN id WHEN 1 THEN id * 1000 + 77 WHEN 2 THEN id * 1234567 ELSE id * 987654321 END AS s FROM listed)
      SELECT id, {_human("s")} AS text FROM z""",
}
