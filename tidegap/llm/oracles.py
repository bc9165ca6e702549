"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS s, least(len(w), 13) AS n
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (s, n)),
hw AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) t(j) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
         list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

_OP1 = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
h AS (
  SELECT doc_id, i, l[i] AS line, ('0x' || substr(md5(l[i]), 1, 8))::BIGINT AS h
  FROM d, unnest(range(1, len(l) + 1)) t(i)),
e AS (
  SELECT *, (h * 31 + coalesce(lag(h) OVER w, 0)) % 2147483647 % 3 = 0 AS ends FROM h
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
chunk AS (
  SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, k),
gone AS (
  SELECT doc_id, k FROM (
    SELECT doc_id, k, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS r FROM chunk WHERE n >= 2)
  WHERE r > 1),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n
  FROM c ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) t(i)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win)
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM again, unnest(range(0, 20)) t(j)),
word AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP3 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id))::BIGINT AS component_id,
  vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

_OP6 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(encode(coalesce(html, ''))) AS x,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
d AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (('0x' || substr(x, 5 * i + 1, 5))::INT >> (15 - 5 * j)) % 32 + 1, 1), '' ORDER BY i, j) AS digest
  FROM p, unnest(range(0, 8)) a(i), unnest(range(0, 4)) b(j) GROUP BY page_id)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN d USING (page_id)
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM d, unnest(range(0, len(x) // 2 - 99)) t(i)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win)
  WHERE n > 1),
span AS (
  SELECT doc_id, i, coalesce(i > 100 + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true) AS starts FROM again),
run AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM span) GROUP BY doc_id, g),
cut AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP12 = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS n
  FROM words, unnest([1, 2, 3, 4]) s(m), unnest(range(1, len(w) - m + 2)) t(i) GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND n >= 30),
part AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS around
  FROM cand, unnest(range(2, m)) t(s), unnest(range(1, m - s + 2)) u(i) GROUP BY ALL),
cut AS (
  SELECT c.lang, c.phrase, a, k, l.n AS l, r.n AS r, 2000000::HUGEINT * a // (l.n + r.n) AS score
  FROM cand c LEFT JOIN part p ON p.lang = c.lang AND p.phrase = c.phrase, unnest(range(1, c.m)) t(k)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.m], ' ')
  WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a),
low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, total.n, score::BIGINT AS score
FROM low JOIN total USING (lang)
QUALIFY rank <= 2000
"""

_OP13 = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ascii(x)::BIGINT) AS key FROM conversations),
crc AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], key), lambda c, b: list_reduce(
      list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind
  FROM src),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w AS prior FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated'
      ELSE '' END AS fault FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
move(k, s, t) AS (  -- k rows inserted first: from state s to t
  VALUES (0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 0, 2), (1, 1, 2), (1, 2, 3), (1, 3, 2),
    (2, 0, 3), (2, 1, 3), (2, 2, 2), (2, 3, 3)),
path AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'c': 0::BIGINT, 'a': ''} AS p FROM counted
  UNION ALL
  SELECT conv_id, i, s, min(p) AS p FROM (
    SELECT r.conv_id, r.i, e.s, {'c': (path.p.c + 5 * k + e.c)::BIGINT, 'a': path.p.a || repeat('I', k) || e.a} AS p
    FROM path JOIN judged r ON r.conv_id IS NOT DISTINCT FROM path.conv_id AND r.i = path.i + 1
    JOIN move ON move.s = path.s,
    unnest([{'s': t, 'c': 2, 'a': 'D'},
      CASE WHEN fault NOT IN ('blank', 'duplicate') THEN
        {'s': CASE t WHEN 2 THEN 3 ELSE 2 END, 'c': 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'a': 'R'} END,
      CASE WHEN fault NOT IN ('blank', 'duplicate') AND (initial = 's' AND t = 0 OR initial = 'u' AND t <> 2
          OR initial = 'a' AND t = 2) THEN
        {'s': CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
         'c': CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'a': 'K'} END]) AS u(e)
    WHERE e IS NOT NULL) GROUP BY conv_id, i, s),
best AS (
  SELECT conv_id, min({'c': path.p.c + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END,
    'a': path.p.a || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS p
  FROM path JOIN counted USING (conv_id) WHERE i = n GROUP BY conv_id),
edit AS (
  SELECT conv_id, j, substr(best.p.a, j, 1) AS e,
    j - length(replace(substr(best.p.a, 1, j), 'I', '')) AS inserted
  FROM best, unnest(range(1, length(best.p.a) + 1)) t(j)),
out AS (
  SELECT edit.*, role, text, initial, row_number() OVER (PARTITION BY conv_id ORDER BY j) AS o,
    first_value(CASE WHEN e = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS skip
  FROM edit LEFT JOIN judged USING (conv_id) WHERE e <> 'D' AND (e = 'I' AND judged.i = 1 OR e <> 'I' AND judged.i = j - inserted)),
repaired AS (
  SELECT conv_id, string_agg(CASE e WHEN 'K' THEN role ELSE CASE (o - skip) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS whole FROM out GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.p.c, 0)::BIGINT AS cost, coalesce(best.p.a, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counted USING (conv_id)
LEFT JOIN best USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""

ORACLES = {"op1_line_dedup": _OP1, "op2_substring_dedup": _OP2, "op3_embedding_near_dedup": _OP3, "op6_warc": _OP6, "op8_suffix_array_dedup": _OP8, "op10_decontamination": _OP10, "op12_phrase_collocations": _OP12, "op13_conversation_repair": _OP13}
