"""SQL for DuckDB that gives what the query of the same name gives."""

from __future__ import annotations

import re

from catalog.epubs import COVER_LINK
from quire.functions.markup import CHARACTERS, PATTERN, RULES, START

ORACLES: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# DuckDB's patterns know no look-behind.
_WITHOUT_LOOKBEHIND = {
    r"<(?<=[^ !-/:-@\[-^`{-~]<)(em|i|u)>": (r"([^ !-/:-@\[-^`{-~])<(em|i|u)>", "$1 <$2>")}


def _apply(rules: list[tuple[str, str, str]], text: str) -> str:
    for kind, found, replacement in rules:
        if kind == PATTERN:
            found, replacement = _WITHOUT_LOOKBEHIND.get(found, (found, replacement))
            groups = re.sub(r"\$(\d)", r"\\\1", replacement)
            text = f"regexp_replace({text}, {_text(found)}, {_text(groups)}, 'g')"
        else:
            function = "translate" if kind == CHARACTERS else "replace"
            text = f"{function}({text}, {_text(found)}, {_text(replacement)})"
    return text


def _markdown(html: str) -> str:
    """The rewriting rules as SQL. Queries that parse HTML in Python are checked by it too,
    so there it is a second, independent way to the same text."""
    return "(" + _apply(RULES, f"({_text(START)} || {html})") + " || chr(10))"


def _entities(text: str) -> str:
    return _apply([rule for rule in RULES if rule[1].startswith("&")], text)


_NAME = "regexp_extract({0}, '([^/]*)/*$', 1)"
_SUFFIX = "regexp_extract(regexp_extract({0}, '([^/]*)/*$', 1), '(?s)^.+(\\.[^.]+)$', 1)"


def _stem(path: str) -> str:
    name, suffix = _NAME.format(path), _SUFFIX.format(path)
    return f"left({name}, length({name}) - length({suffix}))"


def _safe(base: str) -> str:
    cleaned = f"regexp_replace(trim({base}), '[\\\\/:*?\"<>|]', '_', 'g')"
    return f"left({cleaned}, 128) || '.md'"


_INBOX = """inbox AS (
  SELECT *, 'inbox/' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.txt'
      WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.md' ELSE '.odt' END AS path,
    doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.md'
      ELSE '.odt' END AS source_filename,
    CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.md'
      ELSE '.odt' END AS format,
    octet_length(encode(text)) AS length, sha256(text) AS file_hash
  FROM documents)"""

_LEDGER = _INBOX + """, generations AS (
  SELECT i.* EXCLUDE (file_hash), quality, CAST(1 AS BIGINT) AS seq,
    CASE WHEN toxic = 1 THEN sha256(text || ' (draft)') ELSE file_hash END AS file_hash
  FROM inbox i JOIN labels USING (doc_id)
  UNION ALL
  SELECT i.* EXCLUDE (file_hash), quality, CAST(2 AS BIGINT) AS seq, file_hash
  FROM inbox i JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 1),
ledger AS (
  SELECT CASE WHEN lang = 'en' THEN path ELSE 'archive/' || source || '/' || source_filename END
      AS source_path,
    source_filename, length AS source_size, file_hash,
    CASE WHEN quality = 1 THEN doc_id || '.md' ELSE '' END AS output_md,
    CASE WHEN quality = 1 THEN 'attachments/' || file_hash[1:8] ELSE '' END AS output_attachments,
    format, '2024-01-01 00:00:00' AS converted_at,
    CASE WHEN quality = 1 THEN 'success' ELSE 'failed' END AS status,
    CASE WHEN quality = 1 THEN NULL ELSE 'Unexpected error: unreadable' END AS error, seq
  FROM generations),
current AS (
  SELECT * FROM ledger
  QUALIFY row_number() OVER (PARTITION BY source_path, file_hash ORDER BY seq DESC) = 1),
by_path AS (
  SELECT * FROM ledger
  QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY seq DESC, file_hash DESC) = 1),
states AS (
  SELECT i.doc_id, i.path, i.format, i.file_hash, p.status,
    CASE WHEN p.file_hash = i.file_hash THEN 'unchanged'
      WHEN p.file_hash IS NOT NULL THEN 'modified'
      WHEN EXISTS (SELECT 1 FROM ledger m WHERE m.source_filename = i.source_filename
        AND m.source_size = i.length AND m.file_hash = i.file_hash) THEN 'moved'
      ELSE 'new' END AS state
  FROM inbox i LEFT JOIN by_path p ON p.source_path = i.path)"""

_REASONS = """CASE WHEN format NOT IN ('.txt', '.md') THEN 'Unsupported format: ' || format
    WHEN state = 'unchanged' THEN 'Already converted'
    WHEN state = 'moved' THEN 'Already converted under another path'
    WHEN state = 'modified' THEN 'Modified (re-conversion needed)' ELSE 'New' END"""
_ACTIONS = """CASE WHEN format NOT IN ('.txt', '.md') THEN 'unsupported'
    WHEN state IN ('unchanged', 'moved') THEN 'skip' ELSE 'process' END"""

_TREE = """tree AS (
  SELECT doc_id, source, lang, n_chars AS length, '/out/' || source || CASE lang
    WHEN 'es' THEN '/images/' || doc_id || '.png'
    WHEN 'de' THEN '/auto/images/' || doc_id || '.png'
    WHEN 'fr' THEN '/auto/' || source || '-' || doc_id || '.md'
    ELSE '/' || doc_id || '.md' END AS path
  FROM documents)"""

_LINKED = _INBOX + """, linked AS (
  SELECT doc_id, file_hash, '![one](./images/' || doc_id || '.png)' || chr(10)
    || '![two](images/b.jpg) ' || text || chr(10) || '![](http://h.example/q.png) ![x](art/'
    || doc_id || '.gif)' AS md
  FROM inbox)"""

_PAGE_PATH = "regexp_extract(url, '^([^?#]*)', 1)"
_PAGE_SUFFIX = _SUFFIX.format(_PAGE_PATH)
_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"

ORACLES["inbox_scan"] = """
SELECT 'lang=' || lang || '/source=' || source AS folder, '.txt' AS format,
  CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY lang, source"""

_CHAPTER_2 = ("'<html><body><h2>Source</h2><p>' || replace(url, '&', '&amp;') "
              "|| '</p></body></html>'")
_NAV_TEXT = ('<html><body><nav><ol><li><a href="text/chap_01.xhtml">Page</a></li>'
             '<li><a href="text/chap_02.xhtml">Source</a></li></ol></nav></body></html>')

ORACLES["epub_items"] = f"""
WITH items AS (
  SELECT page_id, 0 AS item_pos, 'nav.xhtml' AS name, 'document' AS kind,
    encode({_text(_NAV_TEXT)}) AS body FROM pages
  UNION ALL SELECT page_id, 1, 'text/chap_01.xhtml', 'document',
    encode(html || {_text(COVER_LINK)}) FROM pages
  UNION ALL SELECT page_id, 2, 'images/cover.png', 'image',
    '\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB || encode(url) FROM pages
  UNION ALL SELECT page_id, 3, 'text/chap_02.xhtml', 'document', encode({_CHAPTER_2}) FROM pages
  UNION ALL SELECT page_id, 4, 'style.css', 'other', encode('p{{margin:0}}') FROM pages)
SELECT 'inbox/' || page_id || '.epub' AS path, item_pos, name, kind,
  sha256(body) AS body_hash, CAST(NULL AS VARCHAR) AS error
FROM items"""

ORACLES["manifest_read"] = f"WITH {_LEDGER} SELECT * EXCLUDE (seq) FROM ledger"

ORACLES["ledger_store"] = f"""
WITH {_LEDGER}
SELECT source_path, file_hash, output_md, status, error FROM current"""

ORACLES["ledger_store_repeat"] = ORACLES["ledger_store"]

ORACLES["file_states"] = """
SELECT page_id || '.html' AS source_filename, octet_length(encode(coalesce(html, ''))) AS length,
  sha256(coalesce(html, '')) AS file_hash, 1::BIGINT AS run
FROM pages"""

ORACLES["output_tree"] = f"""
WITH {_TREE}
SELECT '/out/' || source AS subdir, count(*) FILTER (path LIKE '%.md') AS md_count,
  CASE WHEN count(*) FILTER (lang = 'es') > 0 THEN '/out/' || source || '/images' END
    AS images_dir
FROM tree GROUP BY source"""

ORACLES["output_markdown"] = f"""
WITH {_TREE}
SELECT '/out/' || source AS subdir, path AS md_file, length FROM tree WHERE path LIKE '%.md'"""

ORACLES["format_counts"] = f"""
SELECT lower({_PAGE_SUFFIX}) AS format, count(*) AS files FROM pages GROUP BY 1"""

ORACLES["supported_split"] = f"""
SELECT page_id,
  CASE WHEN lower({_PAGE_SUFFIX}) = '.html' THEN 'pending' ELSE 'skipped' END AS status,
  CASE WHEN lower({_PAGE_SUFFIX}) <> '.html' THEN 'Unsupported format: ' || {_PAGE_SUFFIX} END
    AS error
FROM pages"""

ORACLES["fingerprint"] = "SELECT doc_id, sha256(text) AS file_hash FROM documents"

ORACLES["hash_prefix"] = """
SELECT sha256(text)[1:8] AS hash_prefix, count(*) AS files FROM documents GROUP BY 1"""

ORACLES["page_range"] = """
WITH texts AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN ' ' || doc_id || ' - ' || n_chars || ' '
    WHEN lang = 'fr' THEN n_chars || '' WHEN lang = 'de' THEN n_chars || 'x' || doc_id
    WHEN length(source) = 4 THEN '' ELSE '-' || n_chars END AS pages
  FROM documents),
numbers AS (
  SELECT *, TRY_CAST(trim(regexp_extract(pages, '^([^-]*)', 1)) AS INT) AS s,
    TRY_CAST(trim(CASE WHEN contains(pages, '-') THEN substr(pages, strpos(pages, '-') + 1)
      ELSE pages END) AS INT) AS e
  FROM texts),
checked AS (
  SELECT *, coalesce(s >= 1 AND e >= s, FALSE) AS valid, trim(pages) <> '' AS wanted FROM numbers)
SELECT doc_id, pages, CASE WHEN wanted AND valid THEN s - 1 END AS start_page,
  CASE WHEN wanted AND valid THEN e - 1 END AS end_page,
  CASE WHEN wanted AND NOT valid THEN 'Invalid page range: ' || pages END AS page_range_error
FROM checked"""

ORACLES["page_slice"] = """
SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS text
FROM documents"""

ORACLES["page_rows"] = """
SELECT conv_id, turn, role, text FROM conversations WHERE turn BETWEEN 1 AND 2"""

ORACLES["safe_filename"] = f"""
SELECT page_id, {_safe(f"coalesce(nullif({_TITLE}, ''), {_stem(_PAGE_PATH)})")} AS from_title,
  {_safe("url")} AS from_name
FROM pages"""

ORACLES["rewrite_links"] = f"""
WITH {_LINKED}
SELECT doc_id, regexp_replace(md, '(!\\[[^\\]]*\\])\\((?:\\./)?images/([^)]+)\\)',
  '\\1(attachments/' || file_hash[1:8] || '/\\2)', 'g') AS md
FROM linked"""

ORACLES["rewrite_links_mapped"] = f"""
WITH {_LINKED}, cut AS (
  SELECT doc_id, 'attachments/' || file_hash[1:8] AS prefix,
    string_split_regex(md, '!\\[[^\\]]*\\]\\([^)]+\\)') AS segments,
    regexp_extract_all(md, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 1) AS alts,
    regexp_extract_all(md, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 2) AS refs
  FROM linked),
pieces AS (
  SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM cut)
SELECT doc_id, string_agg(segments[i] || CASE WHEN i <= len(refs) THEN '![' || alts[i] || ']('
  || prefix || '/' || CASE WHEN refs[i] = './images/' || doc_id || '.png' THEN 'p' || doc_id
    WHEN refs[i] LIKE '%b.jpg' THEN 'b_1.jpg' ELSE string_split(refs[i], '/')[-1] END || ')'
  ELSE '' END, '' ORDER BY i) AS md
FROM pieces GROUP BY doc_id"""

ORACLES["image_refs"] = f"""
WITH {_LINKED}, refs AS (
  SELECT doc_id, unnest(regexp_extract_all(md, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS ref
  FROM linked)
SELECT doc_id, ref FROM refs WHERE NOT starts_with(ref, 'http://')
  AND NOT starts_with(ref, 'https://')"""

# -- conversion ----------------------------------------------------------------------

ORACLES["html_to_markdown"] = f"""
SELECT 'inbox/' || page_id || '.html' AS path, 'success' AS status, {_markdown("html")} AS md
FROM pages"""

ORACLES["html_to_markdown_sql"] = f"""
SELECT page_id, {_markdown("html")} AS md FROM pages"""

ORACLES["stream_convert"] = ORACLES["html_to_markdown"]

# The converted navigation and the parts around the page itself.
_NAV_MD = "'  1. [Page](text/chap_01.xhtml)' || chr(10) || '  2. [Source](text/chap_02.xhtml)'"
_EPUB_MD = (
    f"{_NAV_MD} || repeat(chr(10), 5) || replace("
    + _markdown(f"(html || {_text(COVER_LINK)})")
    + ", '](../images/cover.png)', '](attachments/cover.png)') || repeat(chr(10), 2) "
    "|| '## Source' || chr(10) || url || chr(10)")
_EPUB_NAME = _safe(f"coalesce(nullif({_entities(_TITLE)}, ''), page_id || '')")

ORACLES["epub_to_markdown"] = f"""
SELECT 'inbox/' || page_id || '.epub' AS path, 'success' AS status, {_EPUB_NAME} AS md_filename,
  1 AS image_count, {_EPUB_MD} AS md
FROM pages"""

ORACLES["epub_images"] = """
SELECT 'cover.png' AS name, 'images/cover.png' AS source_name,
  sha256('\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB || encode(url)) AS body_hash
FROM pages"""

ORACLES["routed_convert"] = f"""
WITH {_INBOX}
SELECT 'inbox/' || page_id || '.html' AS path, '.html' AS format, 'success' AS status,
  CAST(NULL AS VARCHAR) AS error, page_id || '.md' AS md_filename, 0 AS image_count,
  sha256({_markdown("html")}) AS md_hash
FROM pages
UNION ALL
SELECT 'inbox/' || page_id || '.epub', '.epub', 'success', NULL, {_EPUB_NAME}, 1,
  sha256({_EPUB_MD}) FROM pages
UNION ALL
SELECT path, format, CASE WHEN format = '.odt' THEN 'skipped' ELSE 'success' END,
  CASE WHEN format = '.odt' THEN 'Unsupported format: .odt' END,
  CASE WHEN format <> '.odt' THEN doc_id || '.md' END,
  CASE WHEN format <> '.odt' THEN 0 END,
  CASE WHEN format <> '.odt' THEN sha256(text) END
FROM inbox"""

ORACLES["convert_errors"] = f"""
WITH made AS (
  SELECT page_id, {_EPUB_NAME} AS name, starts_with(url, 'http://') AS broken FROM pages)
SELECT 'inbox/' || page_id || '.epub' AS path,
  CASE WHEN broken THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN broken THEN 'File is not a zip file' END AS error,
  CASE WHEN NOT broken THEN name END AS md_filename,
  CASE WHEN broken THEN 0 ELSE 1 END AS image_count
FROM made"""

ORACLES["convert_quarantine"] = """
WITH pages_of AS (
  SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'exit'
    WHEN length(url) % 7 = 0 THEN 'memory' ELSE '' END AS kind FROM pages)
SELECT 'inbox/' || page_id || '.html' AS path,
  CASE WHEN kind = '' THEN 'success' ELSE 'failed' END AS status,
  CASE kind WHEN 'exit' THEN 'conversion ended its process (exit code 7)'
    WHEN 'memory' THEN 'MemoryError' END AS error,
  0 AS image_count
FROM pages_of"""

ORACLES["page_links"] = """
WITH links AS (
  SELECT page_id, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1) AS hrefs FROM pages)
SELECT page_id, CAST(unnest(range(0, len(hrefs))) AS INT) AS pos, unnest(hrefs) AS href
FROM links"""

# -- ledger --------------------------------------------------------------------------

ORACLES["manifest_record"] = f"""
WITH {_INBOX}
SELECT path AS source_path, source_filename, length AS source_size, file_hash,
  CASE WHEN quality = 1 THEN doc_id || '.md' ELSE '' END AS output_md,
  CASE WHEN quality = 1 THEN 'attachments/' || file_hash[1:8] ELSE '' END AS output_attachments,
  format, '2024-01-01 00:00:00' AS converted_at,
  CASE WHEN quality = 1 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN quality = 1 THEN NULL ELSE 'Unexpected error: unreadable' END AS error,
  CAST(3 AS BIGINT) AS seq
FROM inbox JOIN labels USING (doc_id)"""

ORACLES["manifest_upsert"] = f"""
WITH {_LEDGER}, merged AS (
  SELECT source_path, file_hash, output_md, status, error, seq FROM ledger
  UNION ALL
  SELECT source_path, file_hash, source_filename || '.md', 'success', NULL, CAST(3 AS BIGINT)
  FROM ledger WHERE status = 'failed')
SELECT * FROM merged
QUALIFY row_number() OVER (PARTITION BY source_path, file_hash ORDER BY seq DESC) = 1"""

ORACLES["incremental_plan"] = f"WITH {_LEDGER} SELECT path, file_hash, state FROM states"

ORACLES["moved_files"] = f"""
WITH {_LEDGER} SELECT path, file_hash FROM states WHERE state = 'moved'"""

ORACLES["plan"] = f"""
WITH {_LEDGER}
SELECT path, file_hash, {_ACTIONS} AS action, {_REASONS} AS reason FROM states"""

ORACLES["retry_plan"] = f"""
WITH {_LEDGER}
SELECT path,
  CASE WHEN format IN ('.txt', '.md') AND state = 'unchanged' AND status = 'failed'
    THEN 'process' ELSE {_ACTIONS} END AS action,
  CASE WHEN format IN ('.txt', '.md') AND state = 'unchanged' AND status = 'failed'
    THEN 'Failed before' ELSE {_REASONS} END AS reason
FROM states"""

ORACLES["pending"] = f"""
WITH {_LEDGER} SELECT path, file_hash FROM states WHERE {_ACTIONS} = 'process'"""

ORACLES["pending_forced"] = f"""
WITH {_INBOX} SELECT path, file_hash FROM inbox WHERE format IN ('.txt', '.md')"""

ORACLES["status"] = f"""
WITH {_LEDGER}
SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success,
  count(*) FILTER (status <> 'success') AS failed
FROM current"""

ORACLES["converted_list"] = f"""
WITH {_LEDGER}
SELECT source_filename AS file, format, converted_at FROM current WHERE status = 'success'"""

ORACLES["failed_list"] = f"""
WITH {_LEDGER} SELECT source_filename AS file, error FROM current WHERE status <> 'success'"""

_STATS = """
SELECT count(*) AS scanned, count(*) FILTER (quality = 1) AS processed,
  count(*) FILTER (quality IS NULL) AS skipped, count(*) FILTER (quality = 0) AS failed
FROM documents LEFT JOIN labels USING (doc_id)"""
ORACLES["batch_stats"] = _STATS
ORACLES["batch_report_json"] = f"""
SELECT '{{"scanned":' || scanned || ',"processed":' || processed || ',"skipped":' || skipped
  || ',"failed":' || failed || '}}' AS report
FROM ({_STATS})"""

# -- layout --------------------------------------------------------------------------

ORACLES["best_markdown"] = f"""
WITH {_TREE}, candidates AS (
  SELECT '/out/' || source AS subdir, path AS md_file, length,
    contains({_stem("path")}, source) OR contains(source, {_stem("path")}) AS name_matches
  FROM tree WHERE path LIKE '%.md' AND length > 0)
SELECT * FROM candidates QUALIFY row_number() OVER (
  PARTITION BY subdir ORDER BY name_matches DESC, length DESC, md_file) = 1"""

ORACLES["dedupe_names"] = """
WITH numbered AS (
  SELECT doc_id, source, lang, row_number() OVER (
    PARTITION BY source, lang ORDER BY doc_id) - 1 AS n FROM documents)
SELECT doc_id, source, lang || '.png' AS name,
  lang || CASE WHEN n = 0 THEN '' ELSE '_' || n END || '.png' AS saved_name
FROM numbered"""
ORACLES["dedupe_names_buckets"] = ORACLES["dedupe_names"]

# One file after the other, with the names given so far.
ORACLES["dedupe_names_clash"] = """
WITH RECURSIVE files AS (
  SELECT doc_id, source, lang || CASE WHEN n_chars > 3000 THEN '_1' WHEN n_chars > 2000 THEN '_2'
      WHEN n_chars > 1500 THEN '_1_1' ELSE '' END AS stem,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n
  FROM documents),
named AS (
  SELECT source, n, doc_id, stem, stem AS saved, [stem] AS taken FROM files WHERE n = 1
  UNION ALL
  SELECT source, n, doc_id, stem, saved, list_append(taken, saved)
  FROM (
    SELECT f.source, f.n, f.doc_id, f.stem, s.taken,
      CASE WHEN NOT list_contains(s.taken, f.stem) THEN f.stem
        ELSE f.stem || '_' || list_min(list_filter(range(1, len(s.taken) + 2),
          lambda k: NOT list_contains(s.taken, f.stem || '_' || k))) END AS saved
    FROM named s JOIN files f ON f.source = s.source AND f.n = s.n + 1))
SELECT doc_id, source, stem || '.png' AS name, saved || '.png' AS saved_name FROM named"""

ORACLES["name_collisions"] = """
WITH named AS (
  SELECT page_id || '' AS path, regexp_extract(url, '//([^/]*)', 1) || '.md' AS md_filename
  FROM pages)
SELECT path, md_filename, count(*) OVER (PARTITION BY md_filename) > 1 AS shared_name FROM named"""

ORACLES["image_files"] = f"""
WITH {_TREE} SELECT path, length FROM tree WHERE path LIKE '%.png'"""

_WORDS = ", ".join(f"sum(('0x' || d[{8 * i + 1}:{8 * i + 8}])::BIGINT)" for i in range(8))
ORACLES["group_fingerprint"] = f"""
WITH files AS (
  SELECT source, sha256(lang || '/' || doc_id || '.md' || chr(0) || doc_id || '.md' || chr(0)
    || n_chars) AS d FROM documents)
SELECT source, sha256(concat_ws(',', {_WORDS}, count(*))) AS fingerprint
FROM files GROUP BY source"""

ORACLES["orphan_outputs"] = """
SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)"""

# -- validation ----------------------------------------------------------------------

_CHECKED = _INBOX + """, records AS (
  SELECT doc_id, file_hash, CASE WHEN lang = 'es' THEN '' ELSE doc_id || '.md' END AS output_md,
    'attachments/' || file_hash[1:8] AS output_attachments
  FROM inbox),
markdown AS (
  SELECT doc_id, lang, doc_id || '.md' AS output_md, 'attachments/' || file_hash[1:8] AS prefix
  FROM inbox SEMI JOIN labels USING (doc_id)),
kept AS (
  SELECT doc_id, quality, toxic, 'attachments/' || file_hash[1:8] AS prefix
  FROM inbox JOIN labels USING (doc_id)),
missing AS (
  SELECT 'warning' AS severity, 'no_output' AS kind, file_hash AS path, NULL AS ref
  FROM records WHERE output_md = ''
  UNION ALL
  SELECT 'error', 'missing_markdown', output_md, output_md FROM records
  WHERE output_md <> '' AND output_md NOT IN (SELECT output_md FROM markdown)
  UNION ALL
  SELECT 'warning', 'missing_attachments', output_md, output_attachments FROM records
  WHERE output_md <> '' AND output_md IN (SELECT output_md FROM markdown)
    AND output_attachments NOT IN (SELECT prefix FROM kept WHERE toxic = 0)),
links AS (
  SELECT lang, output_md, prefix || '/' || doc_id || '.png' AS ref FROM markdown
  UNION ALL SELECT lang, output_md, prefix || '/b.jpg' FROM markdown),
dangling AS (
  SELECT lang, 'warning' AS severity, 'dangling_ref' AS kind, output_md AS path, ref FROM links
  WHERE ref NOT IN (SELECT prefix || '/' || doc_id || '.png' FROM kept WHERE quality = 1))"""

ORACLES["missing_outputs"] = f"WITH {_CHECKED} SELECT severity, kind, path, ref FROM missing"
ORACLES["dangling_refs"] = f"WITH {_CHECKED} SELECT severity, kind, path, ref FROM dangling"
ORACLES["validation_summary"] = f"""
WITH {_CHECKED}, findings AS (
  SELECT severity FROM missing UNION ALL SELECT severity FROM dangling WHERE lang <> 'es')
SELECT (SELECT count(*) FROM records) AS files_checked,
  count(*) FILTER (severity = 'error') AS errors,
  count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'error') = 0 AS is_valid
FROM findings"""

# -- whole runs and streams ----------------------------------------------------------

ORACLES["convert_run"] = """
SELECT 'inbox/' || page_id || '.html' AS path, sha256(html) AS file_hash, 'success' AS status,
  CAST(NULL AS VARCHAR) AS error, page_id || '.md' AS md_filename, 0 AS image_count
FROM pages"""

ORACLES["convert_run_documents"] = f"""
WITH {_INBOX},
run AS (
  SELECT *, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'skipped'
    WHEN strlen(text) % 7 = 0 THEN 'failed' ELSE 'success' END AS status FROM inbox)
SELECT path, sha256(text) AS file_hash, status,
  CASE status WHEN 'skipped' THEN 'Unsupported format: .odt' WHEN 'failed' THEN 'unreadable' END
    AS error,
  CASE status WHEN 'success' THEN doc_id || '.md' END AS md_filename,
  CASE status WHEN 'skipped' THEN 'Unsupported format: .odt' END AS reason
FROM run"""

ORACLES["markdown_sink"] = f"""
WITH {_INBOX},
numbered AS (
  SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY path) - 1 AS k FROM inbox)
SELECT source || CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.md' AS name,
  sha256(text) AS content_hash
FROM numbered"""

ORACLES["attachment_sink"] = """
SELECT 'attachments/' || left(sha256(text), 8) || '/' || doc_id || '.png' AS name,
  sha256(text) AS content_hash
FROM documents"""

ORACLES["convert_run_again"] = """
SELECT 'inbox/' || page_id || '.html' AS path, 'skip' AS action, 'Already converted' AS reason
FROM pages"""

ORACLES["convert_run_status"] = """
SELECT count(*) AS total, count(*) AS success, CAST(0 AS BIGINT) AS failed FROM pages"""

ORACLES["convert_run_validation"] = """
SELECT count(*) AS files_checked, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS warnings,
  TRUE AS is_valid
FROM pages"""

ORACLES["stream_ledger"] = f"""
WITH {_LEDGER} SELECT source_path, file_hash, output_md, status, error FROM current"""

ORACLES["stream_changes"] = """
SELECT page_id || '.html' AS source_filename, CASE WHEN page_id % 5 = 0 THEN 2 ELSE 1 END AS times,
  octet_length(encode(coalesce(html, ''))) + CASE WHEN page_id % 5 = 0 THEN 8 ELSE 0 END AS length
FROM pages"""

ORACLES["manifest_blocks"] = ORACLES["manifest_read"]

ORACLES["stream_upsert"] = f"""
WITH {_LEDGER} SELECT source_path, file_hash, output_md, status, error, seq AS run FROM current"""

ORACLES["orphans_removed"] = """
SELECT 'n' || page_id % 10 AS name, page_id % 10 >= 7 AS removed,
  count(*) FILTER (page_id % 10 < 7) AS files
FROM pages GROUP BY page_id % 10"""
