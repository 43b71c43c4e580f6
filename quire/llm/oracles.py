"""SQL for DuckDB that gives what the query of the same name gives."""

from __future__ import annotations

from quire.llm.collocations import ABSORBED, LEAST
from quire.llm.collocations import SCALE as PHRASE_SCALE
from quire.llm.collocations import TOP as PHRASE_TOP
from quire.llm.packing import BUCKETS, BUDGET, MAX_LENGTH
from quire.llm.quality import HOST_LIMIT, MOST_STRENGTH
from quire.llm.resampling import BUCKETS as RESAMPLING_BUCKETS
from quire.llm.resampling import LEAST_WORDS, PERCENT, SEED
from quire.llm.secrets import SCOPE
from quire.llm.vectors import SCALE, STEP, TOP

ORACLES: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op1_packing"] = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, len({_WORDS}) AS n
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
lengths AS (
  SELECT row_number() OVER (ORDER BY n) AS j, n, sum(count(*)) OVER (ORDER BY n)::BIGINT AS upto
  FROM rows WHERE n <= {MAX_LENGTH} GROUP BY n),
best AS (
  SELECT 1::BIGINT AS k, j, n * upto AS cost, 0::BIGINT AS cut FROM lengths
  UNION ALL
  SELECT k + 1, j, b.cost, b.cut FROM (
    SELECT p.k, h.j, min({{'cost': p.cost + h.n * (h.upto - i.upto), 'cut': i.j}}) AS b
    FROM best p JOIN lengths i ON i.j = p.j JOIN lengths h ON h.j > p.j
    WHERE p.k < {BUCKETS} GROUP BY p.k, h.j)),
last AS (SELECT k, j, cut FROM best WHERE j = (SELECT max(j) FROM lengths)
  ORDER BY cost, k LIMIT 1),
walk AS (
  SELECT k, j, cut FROM last
  UNION ALL
  SELECT b.k, b.j, b.cut FROM walk w JOIN best b ON b.k = w.k - 1 AND b.j = w.cut),
buckets AS (
  SELECT w.k - 1 AS bucket, l.n AS high, greatest(1, {BUDGET} // greatest(l.n, 1)) AS capacity
  FROM walk w JOIN lengths l USING (j)),
dealt AS (
  SELECT doc_id, n, coalesce(min(bucket), (SELECT count(*) FROM buckets)) AS bucket,
    coalesce(min(high), n) AS high, coalesce(min_by(capacity, high), 1) AS capacity
  FROM rows LEFT JOIN buckets ON n <= high GROUP BY doc_id, n),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS place FROM dealt)
SELECT doc_id, n AS n_tokens, bucket::INT AS bucket, high AS bucket_length,
  place // capacity AS batch, (place % capacity)::INT AS slot, high - n AS padding FROM placed"""

# The link of a weak find is looked for among all parts of its document.
_PATTERNS = {
    "assign": (1, r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?"""
                  r"([A-Za-z0-9+/_.=-]+)", "length(regexp_extract(hit, pattern, 1)) >= 12"),
    "access": (2, "AKIA[A-Z0-9]+", "length(hit) >= 18"),
    "hex": (3, "[0-9a-f]+", "length(hit) >= 16"),
    # a run of the wider class that is all capitals and digits
    "key_id": (4, "[A-Za-z0-9+/]+", "regexp_full_match(hit, '[A-Z0-9]{16,}')"
               " AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[0-9]')"
               " AND NOT starts_with(hit, 'AKIA')"),
    "key_secret": (5, "[A-Za-z0-9+/]{40,}", "regexp_matches(hit, '[a-z]')"
                   " AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[0-9]')"),
    "endpoint": (6, r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D"''<>]+""", "true"),
}


def _cut(kind: str) -> str:
    """Matches that count; their places are sums of the gaps and matches before them."""
    rank, pattern, fits = _PATTERNS[kind]
    fits = fits.replace("pattern", f"'{pattern}'")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, hit, start, start + length(hit) AS stop
  FROM (
    SELECT doc_id, hit, (sum(length(gap)) OVER along + sum(length(hit)) OVER along
      - length(hit))::BIGINT AS start
    FROM (
      SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS hit,
        unnest(regexp_split_to_array(t, '{pattern}')) AS gap,
        generate_subscripts(regexp_split_to_array(t, '{pattern}'), 1) AS i FROM d)
    WHERE hit IS NOT NULL
    WINDOW along AS (PARTITION BY doc_id ORDER BY i))
  WHERE {fits}"""


ORACLES["op4_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(map(_cut, _PATTERNS))}),
alone AS (
  SELECT *, CASE WHEN kind IN ('access', 'key_id') THEN 'id'
    WHEN kind IN ('assign', 'key_secret') THEN 'secret'
    WHEN kind = 'hex' AND (regexp_matches(hit, '[a-f]') OR length(hit) >= 32) THEN 'secret'
    WHEN kind = 'endpoint' THEN 'endpoint' END AS role
  FROM found f WHERE rank <= 3 OR NOT EXISTS (
    SELECT 1 FROM found b WHERE b.rank <= 3 AND b.doc_id = f.doc_id
      AND b.start < f.stop AND b.stop > f.start)),
kept AS (
  SELECT * FROM alone w WHERE rank <= 3 OR EXISTS (
    SELECT 1 FROM alone c WHERE c.doc_id = w.doc_id AND abs(c.start - w.start) <= {SCOPE}
      AND CASE w.role WHEN 'id' THEN c.role = 'secret'
        WHEN 'secret' THEN c.role IN ('id', 'endpoint') ELSE c.role IN ('id', 'secret') END)),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)
      FILTER (rank <= 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""

ORACLES["op8_quality"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, source, {_WORDS} AS ws,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS r FROM windows, range(3) AS s(k) WHERE n > 1
  GROUP BY doc_id),
figures AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, word_chars, n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures),
ruled AS (
  SELECT *, base_failed OR n_symbols * 5 > n_words OR n_dup_lines * 10 > n_lines * 3
    OR word_chars < n_words * 2 OR word_chars > n_words * 15 AS failed FROM judged),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (failed) AS bad FROM ruled
  WHERE source IS NOT NULL GROUP BY source),
fit AS (
  SELECT sum(bad) / sum(n) AS m, CASE WHEN var_pop(bad / n) > 1e-12 THEN least(greatest(
      (sum(bad) / sum(n)) * (1 - sum(bad) / sum(n)) / var_pop(bad / n) - 1, 1), {MOST_STRENGTH})
    ELSE {MOST_STRENGTH} END AS s FROM hosts),
rejected AS (SELECT source FROM hosts, fit WHERE (bad + m * s) / (n + s) > {HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(source IN (SELECT source FROM rejected), false) AS host_rejected,
  NOT base_failed AND NOT coalesce(source IN (SELECT source FROM rejected), false) AS kept
FROM ruled"""

ORACLES["op9_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
    (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
said AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')
      AS replies,
    sum(length('<|im_start|>') + length(role) + 1
      + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1)::BIGINT
      AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(replies) AS loss_chars,
  sha256(replies) AS loss_sha256, formatted_chars FROM said"""

ORACLES["op7_ngram_join"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS} AS ws FROM d),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) END) AS g FROM w),
sizes AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM grams a JOIN grams b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * i >= 90 * (a.n + b.n - i)),
reached AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION
  SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id
FROM sizes JOIN reached USING (doc_id) GROUP BY doc_id, n"""

# The same components, and all links between different sets of n-grams.
ORACLES["op7_ngram_links"] = ORACLES["op7_ngram_join"].split("\nSELECT doc_id, n AS")[0] + """,
sets AS (SELECT doc_id, list(g ORDER BY g) AS s FROM grams GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM sets),
found AS (
  SELECT doc_id, n AS n_shingles, min(other) AS component_id
  FROM sizes JOIN reached USING (doc_id) GROUP BY doc_id, n),
counted AS (
  SELECT a.doc_id, count(DISTINCT b.class_id) FILTER (b.class_id <> a.class_id) AS n_links
  FROM links JOIN classes a ON a.doc_id = x JOIN classes b ON b.doc_id = y GROUP BY a.doc_id)
SELECT doc_id, n_shingles, component_id, coalesce(class_id, doc_id) AS class_id,
  coalesce(n_links, 0) AS n_links
FROM found LEFT JOIN classes USING (doc_id) LEFT JOIN counted USING (doc_id)"""

ORACLES["op10_repeats"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n
  FROM documents),
pieces AS (
  SELECT doc_id, n, p, substr(h, 400 * p + 1, 800) AS h
  FROM (SELECT *, unnest(range(0, (n + 199) // 200)) AS p FROM d)),
starts AS (SELECT doc_id, n, p, h, unnest(range(0, 200)) AS k FROM pieces),
windows AS (
  SELECT doc_id, 200 * p + k AS i,
    count(*) OVER (PARTITION BY md5(substr(h, 2 * k + 1, 400))) AS times
  FROM starts WHERE 200 * p + k <= n - 200),
again AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS new
  FROM windows WHERE times > 1),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM again)
  GROUP BY doc_id, run),
edges AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT doc_id, coalesce(max(s.b), 0), any_value(n) FROM d LEFT JOIN spans s USING (doc_id)
  GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h
  FROM edges JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, n - length(k.h) // 2 AS n_removed, count(s.a) AS n_spans,
  sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN kept k USING (doc_id) LEFT JOIN spans s USING (doc_id) GROUP BY doc_id, n, k.h"""

ORACLES["op13_resampling"] = rf"""
WITH table_of AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
      lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c
    FROM (SELECT unnest(range(256)) AS i))),
texts AS (
  SELECT 0 AS kind, doc_id, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
words AS (
  SELECT kind, doc_id, unnest(list_filter(regexp_split_to_array(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM texts),
times AS (SELECT kind, doc_id, w, count(*) AS n FROM words GROUP BY ALL),
known AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)),
    lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % {RESAMPLING_BUCKETS}
    AS bucket
  FROM (SELECT DISTINCT w FROM times), table_of),
counted AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s,
    coalesce(sum(n) FILTER (kind = 1), 0) AS t
  FROM times JOIN known USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted)
      + {RESAMPLING_BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted)
      + {RESAMPLING_BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counted),
weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight
  FROM times JOIN known USING (w) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))
      ::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS}
    ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS}
  AND place <= {PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {LEAST_WORDS}) // 100
  THEN place END AS rank FROM placed"""

ORACLES["op12_top_products"] = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {STEP} = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""

ORACLES["op11_collocations"] = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2),
    lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS g
  FROM pieces, range(1, 5) AS sizes(m)),
times AS (
  SELECT lang, m, g, string_split(g, ' ') AS ws, count(*) AS f FROM grams GROUP BY ALL
  HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT lang, m, g, f, k, array_to_string(ws[1:k], ' ') AS lg, array_to_string(ws[k + 1:], ' ') AS rg
  FROM times, range(1, 4) AS places(k) WHERE k < m),
best AS (
  SELECT c.lang, c.m, c.g, c.f, min({{'score': {PHRASE_SCALE}::HUGEINT * c.f // (l.f + r.f), 'k': k,
    'l': l.f, 'r': r.f}}) AS b
  FROM cuts c JOIN times l ON l.lang = c.lang AND l.g = lg JOIN times r ON r.lang = c.lang AND r.g = rg
  GROUP BY c.lang, c.m, c.g, c.f),
inner_ones AS (
  SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS g, max(f) AS most
  FROM times, range(1, 4) AS a(i), range(2, 4) AS b(s) WHERE s < m AND i + s - 1 <= m
  GROUP BY ALL),
ranked AS (
  SELECT b.lang, b.g, b.f, b.b, row_number() OVER (
    PARTITION BY b.lang ORDER BY b.b.score DESC, b.f DESC, b.g) AS rank
  FROM best b LEFT JOIN inner_ones i ON i.lang = b.lang AND i.g = b.g
  WHERE most IS NULL OR 100::HUGEINT * most < {ABSORBED}::HUGEINT * b.f)
SELECT lang, rank, g AS phrase, f AS a, b.l AS l, b.r AS r, n, b.score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {PHRASE_TOP}"""
