"""DuckDB SQL with the same results as the queries, over the same tables."""

from __future__ import annotations

from logveil.operators.keywords import STOP_WORDS

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def _clean(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}', ' ', 'g'))"


def _words(text: str) -> str:
    return f"list_filter(string_split({_clean(text)}, ' '), lambda x: x <> '')"


def _shingles(words: str, k: int = 3) -> str:
    parts = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return (
        f"(SELECT list_distinct(list_transform(generate_series(1, len(w) - {k - 1}), "
        f"lambda i: {parts})) FROM (SELECT {words} AS w))"
    )


STAMP = (
    "CASE WHEN doc_id % 10 = 3 THEN '' ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' "
    "+ to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S') END"
)

# the derived message log, one row per message and one per detection
LOG = f"""
base AS (
  SELECT d.doc_id AS seq, d.lang AS tenant_id, d.text AS input_text,
    CASE WHEN d.doc_id % 50 = 7 THEN 'timeout' END AS errors,
    {STAMP.replace('doc_id', 'd.doc_id')} AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS event_ts,
    coalesce(l.toxic, 0) = 1 AS toxic, length(d.text) > 0 AND d.doc_id % 50 <> 7 AS is_valid
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
all_hits AS (
  SELECT seq, 0 AS p, 'Card Number' AS name, 'pattern' AS raw,
    regexp_extract_all(input_text, '\\b[0-9]{{16}}\\b') AS ents FROM base
  UNION ALL SELECT seq, 1, 'IP Address', 'pattern', regexp_extract_all(input_text,
    '\\b[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\b') FROM base
  UNION ALL SELECT seq, 2, 'Phone Number', 'PATTERN ',
    regexp_extract_all(input_text, '\\+1 \\([0-9]{{3}}\\) 555-[0-9]{{4}}') FROM base
  UNION ALL SELECT seq, 3, 'Email Address', 'pattern',
    regexp_extract_all(input_text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+') FROM base
  UNION ALL SELECT seq, 4, 'API Token', 'semantic',
    regexp_extract_all(input_text, 'token = "[0-9a-f]{{40}}"') FROM base
  UNION ALL SELECT seq, 5, 'License Notice', 'ml',
    regexp_extract_all(input_text, '[Ll]icen[sc]e') FROM base
  UNION ALL SELECT seq, 6, 'Toxic Content', 'contextual', [] FROM base WHERE toxic),
found AS (SELECT * FROM all_hits WHERE len(ents) > 0 OR p = 6),
log AS (SELECT *, seq IN (SELECT seq FROM found) AS is_detected FROM base),
valid AS (SELECT * FROM log WHERE is_valid),
dets AS (
  SELECT v.tenant_id, v.seq, f.name, f.raw, f.ents, list_distinct(f.ents) AS uniq,
    row_number() OVER (PARTITION BY v.seq ORDER BY f.p) - 1 AS det_pos,
    len(list_filter(regexp_split_to_array(v.input_text, '{SPACE}'), lambda x: x <> '')) AS tokens,
    CASE WHEN f.p = 6 THEN 'contextual' WHEN f.p IN (4, 5) THEN 'contextual'
      ELSE 'pattern' END AS kind
  FROM valid v JOIN found f ON f.seq = v.seq),
scored AS (
  SELECT *, name AS category, len(ents) AS n_entities, len(uniq) AS n_distinct_entities,
    round(least(1.0, (CASE WHEN kind = 'pattern' THEN 0.6 ELSE 0.2 END)
      + 0.35 * len(list_filter(uniq, lambda e: name = 'Email Address'
          AND regexp_matches(e, '^[^@]+@[^@]+')
          AND right(regexp_extract(e, '[0-9]+'), 1) IN ('0', '2', '4', '6', '8')))
      + 0.2 * len(list_filter(uniq, lambda e:
          regexp_matches(e, '^[\\p{{L}}\\p{{N}}_.-]+@[\\p{{L}}\\p{{N}}_-]+$')))
      + (CASE WHEN tokens < 20 THEN 0.15 ELSE 0 END)
      + (CASE WHEN len(ents) > 3 AND len(uniq) <= 2 THEN 0.15 ELSE 0 END))::DOUBLE, 3) AS score
  FROM dets),
counts AS (
  SELECT tenant_id, count(*) FILTER (is_valid) AS total_messages,
    count(*) FILTER (is_valid AND is_detected) AS messages_with_existing_detection,
    count(*) FILTER (is_valid AND NOT is_detected) AS messages_without_detection,
    count(*) FILTER (NOT is_valid) AS invalid_messages
  FROM log GROUP BY 1)"""

PROFILE = """,
kinds AS (
  SELECT tenant_id, category, kind, count(*) AS n, min(seq * 100 + det_pos) AS first_place
  FROM scored GROUP BY ALL),
dominant AS (
  SELECT tenant_id, category, kind FROM kinds
  QUALIFY row_number() OVER (PARTITION BY tenant_id, category ORDER BY n DESC, first_place) = 1),
profile AS (
  SELECT s.tenant_id, s.category, count(*) AS total_detections,
    count(*) FILTER (s.kind = 'pattern') AS pattern_detections,
    count(*) FILTER (s.kind = 'contextual') AS contextual_detections,
    any_value(d.kind) AS dominant_detection_type,
    sum(score::DECIMAL(20, 3))::DOUBLE / count(*) AS mean_prior,
    min(seq * 100 + det_pos) AS first_place
  FROM scored s JOIN dominant d USING (tenant_id, category) GROUP BY 1, 2 HAVING count(*) >= 2),
sample AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, category
    ORDER BY score DESC, seq, det_pos) AS sample_rank
  FROM scored QUALIFY sample_rank <= 8)"""

RESULTS = (
    PROFILE
    + """,
tally AS (
  SELECT s.tenant_id, s.category, count(*) FILTER (l.quality = 1) AS n_fp,
    count(*) FILTER (l.quality = 0) AS n_tp, count(*) FILTER (l.quality IS NULL) AS n_unc
  FROM sample s LEFT JOIN labels l ON l.doc_id = s.seq GROUP BY 1, 2),
rates AS (
  SELECT p.*, n_fp, n_tp, n_unc,
    CASE WHEN n_fp + n_tp = 0 THEN 0.5 ELSE n_fp / (n_fp + n_tp) END AS rate,
    (n_fp + n_tp) / (n_fp + n_tp + n_unc) AS decided
  FROM profile p JOIN tally USING (tenant_id, category)),
results AS (
  SELECT *, CASE WHEN rate > 0.6 THEN 'high_fp' WHEN rate >= 0.3 THEN 'moderate_fp'
      WHEN rate >= 0.1 THEN 'low_fp' ELSE 'no_fp' END AS verdict,
    round_even(rate * total_detections, 0)::BIGINT AS fp_total,
    round_even(mean_prior, 3) AS shown_prior
  FROM rates),
ranked AS (
  SELECT *, total_detections - fp_total AS tp_total,
    CASE WHEN verdict NOT IN ('high_fp', 'moderate_fp') THEN 'no_action'
      WHEN dominant_detection_type = 'pattern' THEN 'tighten_regex' ELSE 'reduce_scope' END AS tuning,
    CASE verdict WHEN 'high_fp' THEN 0 WHEN 'moderate_fp' THEN 1 WHEN 'low_fp' THEN 2 ELSE 3 END
      AS ord,
    row_number() OVER (PARTITION BY tenant_id ORDER BY ord, rate DESC, mean_prior DESC, first_place)
      AS rank
  FROM results)"""
)

CLUSTERS = f"""
grouped AS (
  SELECT lang AS tenant_id, substr(source, 4)::INT AS label, count(*) AS message_count,
    sum(quality) AS good, count(quality) AS judged,
    min_by({_clean('text')}, d.doc_id) AS first_text, max_by({_clean('text')}, d.doc_id) AS last_text,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(min(d.doc_id)), '%Y-%m-%dT%H:%M:%S')
      AS date_from,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(max(d.doc_id)), '%Y-%m-%dT%H:%M:%S')
      AS date_to
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2),
confident AS (
  SELECT *, CASE WHEN judged > 0 THEN round(1 - good / judged, 3) END AS conf,
    coalesce(conf >= 0.3, false) AS sensitive FROM grouped),
clusters AS (
  SELECT *, label::VARCHAR AS cluster_id, 'source ' || label AS source_name,
    CASE WHEN NOT sensitive THEN NULL WHEN conf >= 0.8 THEN 'critical' WHEN conf >= 0.6 THEN 'high'
      WHEN conf >= 0.45 THEN 'medium' ELSE 'low' END AS risk,
    row_number() OVER (PARTITION BY tenant_id ORDER BY sensitive DESC, conf DESC,
      message_count DESC, label) AS place
  FROM confident)"""

DEDUP = f""",
pre AS (
  SELECT tenant_id, seq, {_clean('input_text')} AS clean_text, {_words('input_text')} AS words
  FROM valid WHERE NOT is_detected),
long_ones AS MATERIALIZED (
  SELECT tenant_id, seq, clean_text, len(words) AS tokens,
    list_transform(words, lambda x: lower(x)) AS w FROM pre WHERE len(words) >= 15),
sets AS (
  SELECT tenant_id, seq, list_distinct(list_transform(generate_series(1, len(w) - 2),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM long_ones),
shingle AS (SELECT tenant_id, seq, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.tenant_id, a.seq AS lo, b.seq AS hi, count(*) / (a.n + b.n - count(*)) AS j
  FROM shingle a JOIN shingle b ON a.tenant_id = b.tenant_id AND a.g = b.g AND a.seq < b.seq
  GROUP BY a.tenant_id, a.seq, b.seq, a.n, b.n HAVING j >= 0.92),
later AS MATERIALIZED (
  SELECT tenant_id, hi, list(lo) AS lows, row_number() OVER (ORDER BY tenant_id, hi) AS k
  FROM pairs GROUP BY 1, 2),
walk AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS gone
  UNION ALL
  SELECT l.k, CASE WHEN len(list_filter(l.lows, lambda x: NOT list_contains(w.gone, x))) > 0
      THEN list_append(w.gone, l.hi) ELSE w.gone END
  FROM walk w JOIN later l ON l.k = w.k + 1),
kept AS (
  SELECT * FROM long_ones
  WHERE seq NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)))"""

FUNNEL = """,
funnel AS (
  SELECT c.*, coalesce(k.n, 0) AS clustered_messages,
    messages_without_detection - coalesce(k.n, 0) AS dropped_in_preprocessing
  FROM counts c LEFT JOIN (SELECT tenant_id, count(*) AS n FROM kept GROUP BY 1) k USING (tenant_id))"""

UNITS = """
raw AS (SELECT vec_id AS seq, embedding::DOUBLE[] AS v FROM embeddings),
units AS (SELECT seq, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM raw),
near AS (
  SELECT a.seq AS lo, b.seq AS hi, 1 - list_dot_product(a.u, b.u) AS distance
  FROM units a JOIN units b ON a.seq < b.seq WHERE 1 - list_dot_product(a.u, b.u) <= 0.65)"""

LABELS = (
    UNITS
    + """,
both_ways AS (SELECT lo AS a, hi AS b FROM near UNION ALL SELECT hi, lo FROM near),
core AS (
  SELECT seq FROM units LEFT JOIN both_ways ON a = seq GROUP BY seq HAVING count(b) + 1 >= 3),
core_edge AS (SELECT a, b FROM both_ways WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (
  SELECT seq AS a, seq AS b FROM core
  UNION
  SELECT reach.a, e.b FROM reach JOIN core_edge e ON e.a = reach.b),
core_root AS (SELECT a AS seq, min(b) AS root FROM reach GROUP BY 1),
cluster_no AS (
  SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS label
  FROM (SELECT DISTINCT root FROM core_root)),
border AS (
  SELECT a AS seq, min(root) AS root FROM both_ways JOIN core_root r ON r.seq = b
  WHERE a NOT IN (FROM core) GROUP BY 1),
labels_of AS (
  SELECT u.seq, coalesce(n.label, -1) AS label, c.seq IS NOT NULL AS is_core,
    CASE WHEN n.label IS NULL THEN 'noise' ELSE n.label::VARCHAR END AS cluster_id
  FROM units u LEFT JOIN core_root c ON c.seq = u.seq LEFT JOIN border o ON o.seq = u.seq
    LEFT JOIN cluster_no n ON n.root = coalesce(c.root, o.root))"""
)

_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
TERMS = f"""
docs AS (
  SELECT doc_id, substr(source, 4)::INT AS label, {_clean('text')} AS clean_text FROM documents),
toks AS (
  SELECT doc_id, label, list_filter(regexp_extract_all(lower(clean_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda t: t NOT IN ({_STOPS})) AS w FROM docs),
occ AS (
  SELECT doc_id, label, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM toks),
tf AS (SELECT label, doc_id, term, count(*) AS n FROM occ GROUP BY ALL),
vocab AS (
  SELECT label, term, sum(n) AS tf, count(*) AS df FROM tf GROUP BY label, term
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY sum(n) DESC, term) <= 300),
sizes AS (SELECT label, count(*) AS nd FROM docs GROUP BY 1),
w AS (
  SELECT t.label, t.doc_id, t.term, t.n * (ln((1 + nd) / (1 + df)) + 1) AS w, nd
  FROM tf t JOIN vocab v ON v.label = t.label AND v.term = t.term JOIN sizes s ON s.label = t.label),
normed AS (
  SELECT label, term, nd, w / sqrt(sum(w * w) OVER (PARTITION BY label, doc_id)) AS x FROM w),
weights AS (SELECT label, term, sum(x) / any_value(nd) AS weight FROM normed GROUP BY 1, 2)"""

# entities do not overlap themselves here, so the pieces between hits give their places
WINDOWS = """,
pieces AS (
  SELECT d.seq, d.det_pos, v.input_text, length(v.input_text) AS n, length(e) AS le,
    string_split(lower(v.input_text), lower(e)) AS parts
  FROM dets d JOIN valid v ON v.seq = d.seq, unnest(d.ents) AS t(e)),
spots AS (
  SELECT seq, det_pos, n, le,
    unnest(list_transform(generate_series(1, len(parts) - 1),
      lambda i: (list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * le)::INT)) AS pos
  FROM pieces),
win AS (
  SELECT DISTINCT seq, det_pos, greatest(0, pos - 300) AS s, least(n, pos + le + 300) AS e FROM spots),
marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY seq, det_pos ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM win),
islands AS (
  SELECT *, sum(starts) OVER (PARTITION BY seq, det_pos ORDER BY s, e) AS island FROM marked)"""

SNIPPETS = """,
chunks AS (
  SELECT m.*, row_number() OVER (PARTITION BY m.seq, det_pos ORDER BY s) AS place,
    (CASE WHEN s > 0 THEN '…' ELSE '' END) || substr(v.input_text, (s + 1)::INT, (e - s)::INT)
      || (CASE WHEN e < length(v.input_text) THEN '…' ELSE '' END) AS chunk
  FROM (SELECT seq, det_pos, island, min(s) AS s, max(e) AS e FROM islands GROUP BY 1, 2, 3) m
    JOIN valid v ON v.seq = m.seq),
fold AS (
  SELECT DISTINCT seq, det_pos, 0::BIGINT AS k, 0::BIGINT AS used, false AS is_full,
    []::VARCHAR[] AS parts FROM chunks
  UNION ALL
  SELECT f.seq, f.det_pos, c.place,
    CASE WHEN length(chunk) <= 1200 - used THEN used + length(chunk) ELSE used END,
    length(chunk) > 1200 - used,
    CASE WHEN length(chunk) <= 1200 - used THEN list_append(parts, chunk)
      WHEN 1200 - used > 60 THEN list_append(parts, substr(chunk, 1, (1200 - used)::INT) || '…')
      ELSE parts END
  FROM fold f JOIN chunks c ON c.seq = f.seq AND c.det_pos = f.det_pos AND c.place = f.k + 1
  WHERE NOT f.is_full),
folded AS (
  SELECT seq, det_pos, array_to_string(arg_max(parts, k), chr(10) || '---' || chr(10)) AS shown
  FROM fold GROUP BY 1, 2),
shown AS (
  SELECT d.seq, d.det_pos, CASE WHEN len(d.ents) > 0 THEN f.shown
    WHEN length(v.input_text) <= 1200 THEN v.input_text
    ELSE substr(v.input_text, 1, 585) || chr(10) || '…[middle truncated]…' || chr(10)
      || substr(v.input_text, length(v.input_text) - 584) END AS shown
  FROM dets d JOIN valid v ON v.seq = d.seq
    LEFT JOIN folded f ON f.seq = d.seq AND f.det_pos = d.det_pos)"""

LEDGER = """
runs AS (
  SELECT event_id::VARCHAR AS run_id, ts - INTERVAL 72 HOUR AS start_ts, ts AS end_ts,
    user_id::VARCHAR AS mode, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status
  FROM events)"""

PERCENT = "CASE WHEN {d} = 0 THEN '—' ELSE printf('%.1f%%', {n} / {d} * 100.0) END"

ORACLE = {
    "suspicious_topn": f"WITH {LOG}{PROFILE} SELECT tenant_id, category, sample_rank, seq, det_pos, kind, tokens, score FROM sample",
    "message_split": f"WITH {LOG} SELECT *, {PERCENT.format(n='messages_with_existing_detection', d='total_messages')} AS detection_rate FROM counts",
    "split_and_union": f"WITH {LOG} SELECT tenant_id, is_detected, count(*) AS messages, sum(length(input_text)) AS characters FROM valid GROUP BY 1, 2",
    "existing_detections": f"WITH {LOG} SELECT tenant_id, name, count(*) AS detections FROM dets GROUP BY 1, 2",
    "detection_rows": f"WITH {LOG} SELECT tenant_id, seq, det_pos, category, kind, n_entities, n_distinct_entities, score FROM scored",
    "category_profile": f"WITH {LOG}{PROFILE} SELECT tenant_id, category, row_number() OVER (PARTITION BY tenant_id ORDER BY mean_prior DESC, first_place) AS rank, total_detections, pattern_detections, contextual_detections, dominant_detection_type, round(mean_prior, 6) AS mean_prior, round_even(mean_prior, 3) AS mean_heuristic_fp_prior FROM profile",
    "detection_rate_72h": f"""WITH {LOG}, binned AS (SELECT tenant_id, is_detected, (epoch(event_ts)::BIGINT // 259200) * 259200 AS window_start FROM valid)
SELECT tenant_id, window_start, window_start + 259200 AS window_end, count(*) AS total_messages, count(*) FILTER (is_detected) AS detected_messages, {PERCENT.format(n='count(*) FILTER (is_detected)', d='count(*)')} AS detection_rate FROM binned GROUP BY 1, 2""",
    "normalized_tokens": f"SELECT conv_id, turn, len({_words('text')}) AS tokens, md5({_clean('text')}) AS clean_md5 FROM conversations",
    "shingle_sets": f"""WITH w AS (SELECT doc_id, list_transform({_words('text')}, lambda x: lower(x)) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w)
SELECT doc_id, len(s) AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS shingles_md5 FROM s""",
    "turn_overlap": f"""WITH w AS (SELECT conv_id, turn, list_transform({_words('text')}, lambda x: lower(x)) AS w FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(w) AS a, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS b FROM w),
l AS (SELECT *, lag(a) OVER o AS pa, lag(b) OVER o AS pb FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn,
 CASE WHEN len(a) = 0 OR len(pa) = 0 THEN 0.0 ELSE round(len(list_intersect(a, pa)) / (len(a) + len(pa) - len(list_intersect(a, pa))), 6) END AS word_overlap,
 CASE WHEN len(b) = 0 OR len(pb) = 0 THEN 0.0 ELSE round(len(list_intersect(b, pb)) / (len(b) + len(pb) - len(list_intersect(b, pb))), 6) END AS shingle_overlap
FROM l WHERE pa IS NOT NULL""",
    "head_tail": """WITH t AS (SELECT doc_id, length(text) > 1200 AS truncated, CASE WHEN length(text) <= 1200 THEN text ELSE substr(text, 1, 585) || chr(10) || '…[middle truncated]…' || chr(10) || substr(text, length(text) - 584) END AS shown FROM documents)
SELECT doc_id, length(shown) AS shown_chars, md5(shown) AS shown_md5, truncated FROM t""",
    "json_in_text": """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok ' || props || ' bye' WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'none' WHEN 3 THEN '{"a":' || event_type ELSE '```' || chr(10) || '[' || props || ']' || chr(10) || '```' END AS raw FROM events),
p AS (SELECT event_id, regexp_extract(raw, '(?s)\\{.*\\}') AS braces, trim(regexp_replace(regexp_replace(raw, '```(?:json)?', '', 'g'), '`+$', ''), chr(10) || ' ') AS bare FROM r)
SELECT event_id, CASE WHEN braces <> '' AND json_valid(braces) THEN braces WHEN json_valid(bare) THEN bare END AS found FROM p""",
    "dedup_jaccard": f"WITH RECURSIVE {LOG}{DEDUP} SELECT tenant_id, seq, tokens, md5(clean_text) AS clean_md5 FROM kept",
    "burst_first_wins": """WITH steps AS (SELECT user_id, event_id, ts, lag(event_id) OVER o AS prev, lag(ts) OVER o AS prev_ts FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
flagged AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(prev_ts) <= 600000000 AND prev < event_id, false) AS joined FROM steps),
runs AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM flagged),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place FROM runs)
SELECT user_id::VARCHAR AS tenant_id, event_id AS seq FROM placed WHERE place % 2 = 0""",
    "funnel": f"WITH RECURSIVE {LOG}{DEDUP}{FUNNEL} SELECT * FROM funnel",
    "run_status": f"""WITH RECURSIVE {LOG}{DEDUP}{FUNNEL} SELECT tenant_id,
CASE WHEN messages_without_detection = 0 THEN 'No undetected messages found' WHEN clustered_messages < 100 THEN 'Only ' || clustered_messages || ' messages after preprocessing — not enough to cluster' ELSE 'ok' END AS intent_status,
CASE WHEN messages_with_existing_detection = 0 THEN 'No detected messages found' ELSE 'ok' END AS fp_status FROM funnel""",
    "unit_vectors": f"WITH {UNITS} SELECT seq AS vec_id, i - 1 AS dim, round(u[i], 6) AS x FROM units, generate_series(1, len(u)) AS g(i)",
    "eps_edges": f"WITH {UNITS} SELECT lo, hi, round(distance, 6) AS distance FROM near",
    "dbscan_labels": f"WITH RECURSIVE {LABELS} SELECT seq, label, is_core, cluster_id FROM labels_of",
    "cluster_sizes": f"WITH RECURSIVE {LABELS} SELECT label, cluster_id, count(*) AS message_count FROM labels_of GROUP BY 1, 2",
    "cluster_summary": f"WITH RECURSIVE {LABELS} SELECT count(DISTINCT label) FILTER (label >= 0) AS n_clusters, count(*) FILTER (label = -1) AS n_noise, count(*) AS n_messages FROM labels_of",
    "centroids": "WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, i - 1 AS place, round(avg(x), 6) AS x FROM x GROUP BY 1, 2",
    "representatives": """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2), cen AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1),
d AS (SELECT e.label, vec_id AS seq, 1 - list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(c, c)) AS distance FROM embeddings e JOIN cen ON cen.label = e.label)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY distance, seq) AS place, seq, round(distance, 6) AS distance FROM d QUALIFY place <= 5""",
    "cluster_dates": f"WITH d AS (SELECT substr(source, 4)::INT AS label, nullif({STAMP}, '') AS stamp FROM documents) SELECT label, count(*) AS message_count, min(stamp) AS date_from, max(stamp) AS date_to FROM d GROUP BY 1",
    "cluster_keywords": f"WITH {TERMS} SELECT label, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term) AS place, term FROM weights QUALIFY place <= 10",
    "keyword_weights": f"WITH {TERMS} SELECT label, term, round(weight, 6) AS weight FROM weights",
    "single_doc_words": f"""WITH w AS (SELECT doc_id, list_transform({_words('text')}, lambda x: lower(x)) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM w),
n AS (SELECT doc_id, term, count(*) AS n, min(pos) AS pos FROM x WHERE length(term) > 3 GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS place, term FROM n QUALIFY place <= 10""",
    "entity_windows": f"WITH {LOG}{WINDOWS} SELECT seq, det_pos, s, e FROM win",
    "merged_windows": f"WITH {LOG}{WINDOWS}, merged AS (SELECT seq, det_pos, island, min(s) AS s, max(e) AS e FROM islands GROUP BY 1, 2, 3) SELECT seq, det_pos, row_number() OVER (PARTITION BY seq, det_pos ORDER BY s) - 1 AS place, s, e FROM merged",
    "snippet_texts": f"WITH RECURSIVE {LOG}{WINDOWS}{SNIPPETS} SELECT seq, det_pos, length(shown) AS shown_chars, md5(shown) AS shown_md5 FROM shown",
    "hashed_embedding": "SELECT doc_id AS seq, 256 AS dimensions, 1.0::DOUBLE AS length FROM documents",
    "reduced_embedding": "SELECT vec_id AS seq, 8 AS dimensions FROM embeddings",
    "judge_requests": "SELECT doc_id, 'Judge ' || coalesce(source, '') || ' in ' || coalesce(nullif(lang, 'fr'), '') || ': {\"doc_id\":' || doc_id || ',\"n_chars\":' || n_chars || '}' AS request FROM documents",
    "cluster_payloads": f"WITH d AS (SELECT substr(source, 4) AS cluster_id, nullif({STAMP}, '') AS stamp FROM documents) SELECT cluster_id, count(*) AS message_count, min(stamp) AS date_from, max(stamp) AS date_to, 10 AS n_keywords, least(5, count(*)) AS n_representatives FROM d GROUP BY 1",
    "judge_attempts": f"WITH {LOG}{PROFILE} SELECT tenant_id, category, least(3, 1 + length(category) % 4) AS attempts, length(category) % 4 <= 2 AS judged FROM profile",
    "audit_trail": f"""WITH {LOG}{RESULTS}, j AS (SELECT tenant_id, count(*) AS n, count(*) FILTER (ord = 0) AS h FROM ranked GROUP BY 1),
calls AS (SELECT tenant_id, category, length(category) % 4 AS late, unnest(range(1, least(3, 1 + length(category) % 4) + 1)) AS attempt,
  '{{"category":"' || category || '","total_detections":' || total_detections || '}}' AS request FROM profile),
sources AS (SELECT substr(source, 4) AS cluster_id, count(*) AS n FROM documents GROUP BY 1)
SELECT 'fp_category' AS event, tenant_id, category AS name, total_detections AS n, dominant_detection_type AS note, least(8, total_detections)::BIGINT AS more, NULL AS asked, round_even(mean_prior, 3) AS mean_fp_prior FROM profile
UNION ALL SELECT 'run_start', tenant_id, 'fp', total_messages, messages_with_existing_detection::VARCHAR, 7, NULL, NULL FROM counts
UNION ALL SELECT 'run_end', tenant_id, 'fp', coalesce(n, 0), CASE WHEN messages_with_existing_detection = 0 THEN 'no_detected' ELSE 'ok' END, coalesce(h, 0), NULL, NULL FROM counts LEFT JOIN j USING (tenant_id)
UNION ALL SELECT 'llm_call', tenant_id, category, attempt, CASE WHEN attempt > late THEN 'ok' ELSE 'no_json_in_response' END, 1, md5(request || CASE WHEN attempt > late THEN ' {{}} {{}}' ELSE ' not yet' END), NULL FROM calls
UNION ALL SELECT 'cluster_built', 'all', cluster_id, n, 'k' || cluster_id, NULL, NULL, NULL FROM sources
UNION ALL SELECT 'cluster_summary', 'all', 'given', sum(n)::BIGINT, count(*)::VARCHAR, 0, NULL, NULL FROM sources""",
    "saved_runs": f"""WITH {LOG}{RESULTS}, {CLUSTERS}
SELECT 'r1' AS run_id, 'intent' AS mode, tenant_id, place::INT AS rank, cluster_id, source_name AS name, message_count AS n, epoch_us(TIMESTAMP '2024-02-01 02:00:00') AS finished FROM clusters WHERE sensitive
UNION ALL SELECT 'r1', 'fp', tenant_id, rank::INT, NULL, category, total_detections, epoch_us(TIMESTAMP '2024-02-01 02:00:00') FROM ranked WHERE ord <= 1""",
    "explorer_options": f"""WITH {LOG}{RESULTS}, e AS (SELECT s.tenant_id, s.category, row_number() OVER (PARTITION BY s.tenant_id, s.category ORDER BY s.sample_rank) - 1 AS example, s.sample_rank, s.seq, l.doc_id AS known, l.quality FROM sample s LEFT JOIN labels l ON l.doc_id = s.seq)
SELECT r.tenant_id, r.category, r.ord AS option, e.example AS place, left(input_text, 100) AS snippet, '—' AS flagged_entity, e.sample_rank::VARCHAR AS subcategory, CASE WHEN e.known IS NULL THEN '—' WHEN e.quality = 0 THEN 'TP' WHEN e.quality = 1 THEN 'FP' ELSE 'UNCERTAIN' END AS verdict, '—' AS reason
FROM ranked r JOIN e ON e.tenant_id = r.tenant_id AND e.category = r.category JOIN base b ON b.seq = e.seq""",
    "category_payloads": f"""WITH {LOG}{PROFILE} SELECT p.tenant_id, p.category, p.dominant_detection_type, p.total_detections, least(8, p.total_detections) AS samples_shown, s.sample_rank - 1 AS place, s.score, length(v.input_text) > 1200 AS truncated, s.seq || ':' || s.name AS id, s.raw AS detection_type, s.n_entities, s.n_distinct_entities AS n_subtypes
FROM profile p JOIN sample s ON s.tenant_id = p.tenant_id AND s.category = p.category JOIN valid v ON v.seq = s.seq""",
    "verdict_tallies": f"WITH {LOG}{RESULTS} SELECT tenant_id, category, n_fp AS estimated_fp_count_in_sample, n_tp AS estimated_tp_count_in_sample, n_unc AS n_uncertain, round(rate, 6) AS estimated_fp_rate, round(decided, 6) AS fp_rate_confidence, verdict AS overall_assessment, total_detections AS total_detections_in_period, fp_total AS estimated_fp_count_total, tp_total AS estimated_tp_count_total FROM ranked",
    "quota_refill": f"""WITH {LOG}{RESULTS}, o AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY mean_prior DESC, first_place) AS prior_rank FROM results)
SELECT tenant_id, category, prior_rank AS rank, verdict AS overall_assessment FROM o WHERE decided > 0.3 QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY prior_rank) <= 3""",
    "action_required": f"WITH {LOG}{RESULTS} SELECT tenant_id, rank, category, dominant_detection_type AS detection_type, verdict AS assessment, round(rate, 6) AS estimated_fp_rate, total_detections, fp_total AS estimated_fp_total, tp_total AS estimated_tp_total, tuning AS tuning_recommendation, shown_prior AS mean_heuristic_fp_prior FROM ranked WHERE ord <= 1",
    "fp_summary": f"""WITH {LOG}{RESULTS}, j AS (SELECT tenant_id, count(*) AS n, count(*) FILTER (ord = 0) AS h, count(*) FILTER (ord = 1) AS m FROM ranked GROUP BY 1)
SELECT c.tenant_id, total_messages, messages_with_existing_detection AS messages_with_detection, messages_without_detection, invalid_messages, coalesce(n, 0) AS categories_analyzed, coalesce(h, 0) AS high_fp_categories, coalesce(m, 0) AS moderate_fp_categories FROM counts c LEFT JOIN j ON j.tenant_id = c.tenant_id""",
    "suggestions": f"WITH {CLUSTERS} SELECT tenant_id, place AS rank, cluster_id, source_name AS intent_name, 'prose ' || tenant_id AS intent_category, risk AS risk_level, conf AS confidence, message_count AS message_count_in_cluster, tenant_id || ',' || source_name || ',k3,k4,k5,k6' AS keywords, date_from FROM clusters WHERE sensitive",
    "sensitive_rate": f"WITH {CLUSTERS} SELECT tenant_id, count(*) AS clusters_analyzed, count(*) FILTER (sensitive) AS sensitive_clusters_found, round(count(*) FILTER (sensitive) / count(*), 6) AS sensitive_rate FROM clusters GROUP BY 1",
    "cluster_order": f"WITH {CLUSTERS} SELECT tenant_id, cluster_id, message_count, row_number() OVER (PARTITION BY tenant_id ORDER BY message_count DESC, label) AS rank FROM clusters",
    "cluster_conformance": f"""WITH {CLUSTERS}, t AS (SELECT *, substr(first_text, 1, 150) AS e1, substr(last_text, 1, 250) AS e2, substr(last_text, 1, 240) AS m2 FROM clusters)
SELECT tenant_id, cluster_id, 'evidence_length' AS rule FROM t WHERE length(e1) > 200 OR length(e2) > 200
UNION ALL SELECT tenant_id, cluster_id, 'evidence_verbatim' FROM t WHERE NOT (contains(first_text, e1) OR contains(m2, e1)) OR NOT (contains(first_text, e2) OR contains(m2, e2))
UNION ALL SELECT tenant_id, cluster_id, 'enough_counters' FROM t WHERE label % 3 = 0
UNION ALL SELECT tenant_id, cluster_id, 'insensitive_is_blank' FROM t WHERE NOT sensitive""",
    "category_conformance": f"""WITH {LOG}{RESULTS}
SELECT tenant_id, category, 'contextual_tuning' AS rule FROM ranked WHERE dominant_detection_type = 'contextual'
UNION ALL SELECT tenant_id, category, 'assessment_matches_rate' FROM ranked WHERE verdict <> 'moderate_fp'
UNION ALL SELECT tenant_id, category, 'disable_risk_known' FROM ranked
UNION ALL SELECT tenant_id, category, 'verdicts_known' FROM ranked WHERE n_unc > 0""",
    "explorer_overview": f"WITH {LOG} SELECT tenant_id, total_messages, messages_with_existing_detection AS detected, messages_without_detection AS undetected, {PERCENT.format(n='messages_with_existing_detection', d='total_messages')} AS detection_rate FROM counts",
    "explorer_value_counts": f"""WITH {LOG}{RESULTS}, {CLUSTERS}
SELECT tenant_id, verdict AS value, count(*) AS n, 'overall_assessment' AS field FROM ranked GROUP BY 1, 2
UNION ALL SELECT tenant_id, tuning, count(*), 'tuning_recommendation' FROM ranked GROUP BY 1, 2
UNION ALL SELECT tenant_id, coalesce(risk, '—'), count(*), 'risk_level' FROM clusters GROUP BY 1, 2""",
    "explorer_suggestions": f"WITH {CLUSTERS} SELECT tenant_id, place AS rank, source_name AS intent_name, risk AS risk_level, conf AS confidence FROM clusters WHERE sensitive AND risk IN ('critical', 'high', 'medium') AND conf >= 0.4 AND contains(source_name, 'source 1')",
    "explorer_cards": f"""WITH {CLUSTERS} SELECT tenant_id, place AS rank, substr(date_from, 1, 10) AS first_day, substr(date_to, 1, 10) AS last_day, 0 AS place, substr(first_text, 1, 120) AS evidence FROM clusters WHERE sensitive
UNION ALL SELECT tenant_id, place, substr(date_from, 1, 10), substr(date_to, 1, 10), 1, substr(last_text, 1, 120) FROM clusters WHERE sensitive""",
    "explorer_clusters": f"WITH {CLUSTERS} SELECT tenant_id, cluster_id, sensitive, upper(coalesce(risk, '—')) AS risk_level, printf('%.0f%%', round_even(coalesce(conf, 0) * 100.0, 0)) AS confidence, CASE WHEN sensitive THEN source_name ELSE '—' END AS intent_name, CASE WHEN sensitive THEN 'prose ' || tenant_id ELSE '—' END AS category, message_count AS messages, CASE WHEN sensitive THEN source_name || ' detector' ELSE '—' END AS suggested_model FROM clusters",
    "explorer_scatter": f"WITH {LOG}{RESULTS} SELECT tenant_id, category, round(rate, 6) AS fp_rate, total_detections, verdict AS assessment, round(greatest(decided, 0.1), 6) AS confidence FROM ranked",
    "explorer_actions": f"WITH {LOG}{RESULTS} SELECT tenant_id, rank, category, verdict AS assessment, printf('%.0f%%', round_even(rate * 100.0, 0)) AS fp_rate, printf('%.0f%%', round_even(decided * 100.0, 0)) AS fp_confidence, total_detections, tp_total AS est_tp, fp_total AS est_fp, tuning, dominant_detection_type AS detection_type, CASE WHEN n_unc > 0 THEN 'medium' ELSE '—' END AS risk_of_disabling FROM ranked WHERE ord <= 1 AND contains(lower(category), 'e')",
    "explorer_drilldown": f"WITH {LOG}{RESULTS} SELECT tenant_id, rank, category, verdict AS overall_assessment, n_fp AS estimated_fp_count_in_sample, n_tp AS estimated_tp_count_in_sample, n_unc AS n_uncertain FROM ranked WHERE category = 'License Notice'",
    "explorer_categories": f"WITH {LOG}{RESULTS} SELECT tenant_id, category, verdict AS assessment, printf('%.0f%%', round_even(rate * 100.0, 0)) AS fp_rate, printf('%.0f%%', round_even(decided * 100.0, 0)) AS fp_confidence, total_detections, tp_total AS est_tp, fp_total AS est_fp, n_tp AS sample_tp, n_fp AS sample_fp, tuning, printf('%.2f', shown_prior) AS prior, dominant_detection_type AS detection_type, ord AS place FROM ranked",
    "window_read": f"WITH {LOG} SELECT tenant_id, seq, created_at FROM log WHERE event_ts BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-01 10:00:00'",
    "envelope_unwrap": "SELECT event_id AS payload_id, pos, event_id, user_id, event_type FROM events, (SELECT unnest([0, 1]) AS pos)",
    "tenant_preflight": "SELECT DISTINCT user_id::VARCHAR AS tenant_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)",
    "coverage_audit": f"""WITH {LEDGER}, l AS (SELECT *, (epoch_us(start_ts) - epoch_us(lag(end_ts) OVER (PARTITION BY mode ORDER BY start_ts, run_id))) / 3.6e9 AS apart FROM runs WHERE status = 'ok')
SELECT mode, run_id, round(greatest(apart, 0.0), 6) AS gap_hours, round(greatest(-apart, 0.0), 6) AS overlap_hours, CASE WHEN apart > 0 THEN 'gap' WHEN apart < 0 THEN 'overlap' ELSE 'ok' END AS coverage FROM l""",
    "next_due": f"WITH {LEDGER}, l AS (SELECT mode, max(CASE WHEN status = 'ok' THEN end_ts END) AS last_run FROM runs GROUP BY 1) SELECT mode, round(greatest(0.0, coalesce(259200.0 - (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(last_run)) / 1e6, 0.0)), 3) AS seconds_left FROM l",
    "last_run": f"WITH {LEDGER} SELECT epoch_us(max(end_ts)) AS last_run_micros FROM runs WHERE status = 'ok'",
    "array_log": f"WITH {LOG}, n AS (SELECT seq, count(*) AS n FROM dets GROUP BY 1) SELECT tenant_id, created_at, md5(input_text) AS text_md5, coalesce(n, 0) AS detections FROM valid v LEFT JOIN n ON n.seq = v.seq",
    "stream_intake": f"WITH {LOG} SELECT tenant_id, CASE WHEN created_at <> '' THEN substr(created_at, 1, 10) END AS event_date, count(*) AS records, sum(length(input_text)) AS characters FROM log GROUP BY 1, 2",
    "report_roundtrip": f"WITH {LOG}{RESULTS} SELECT tenant_id, rank, category, verdict AS assessment, total_detections FROM ranked WHERE ord <= 1",
    "fp_job": f"WITH {LOG}{RESULTS} SELECT tenant_id, rank, category, verdict AS assessment FROM ranked WHERE ord <= 1",
}
ORACLE["payload_roundtrip"] = ORACLE["category_payloads"]
