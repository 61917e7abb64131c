"""SQL counterparts of the queries 11 to 13."""

OP11 = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
      FROM (SELECT lang, unnest(pieces) AS piece FROM t)),
f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS g, count(*) AS n FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
    FROM p CROSS JOIN (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, n AS a, string_split(g, ' ') AS ws FROM f WHERE k > 1 AND n >= 30),
cut AS (SELECT lang, g, k, a, at_, array_to_string(ws[1:at_], ' ') AS x,
               array_to_string(ws[at_ + 1:], ' ') AS y
        FROM (SELECT *, unnest(range(1, k)) AS at_ FROM c)),
scored AS (
  SELECT cut.lang, cut.g, a, fx.n AS l, fy.n AS r,
         CAST(2000000 * CAST(a AS HUGEINT) // (CAST(fx.n AS HUGEINT) + fy.n) AS BIGINT) AS score, at_
  FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.g = x JOIN f fy ON fy.lang = cut.lang AND fy.g = y),
best AS (SELECT * FROM scored
         QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, at_) = 1),
inside AS (
  SELECT lang, sub, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS sub FROM (
      SELECT lang, a, ws, k, m, unnest(range(1, k - m + 2)) AS i
      FROM c CROSS JOIN (SELECT unnest([2, 3]) AS m) WHERE m < k)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND sub = g
         WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank
           FROM kept)
SELECT ranked.lang, rank, g AS phrase, a, l, r, CAST(totals.n AS BIGINT) AS n, score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

OP12 = r"""
WITH RECURSIVE tbl AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2)
                          ELSE c // 2 END, i) ORDER BY i) AS v FROM (SELECT unnest(range(256)) AS i)),
named AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s
  FROM conversations),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(
           list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT)),
           lambda c, b: xor(c // 256, v[xor(c, b) % 256 + 1]), 4294967295)) % 20 AS kind
  FROM named CROSS JOIN tbl),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
              ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy_
  FROM coded WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))
              AS i,
         regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS signs, substr(role || ' ', 1, 1) AS c
  FROM damaged),
r AS (
  SELECT conv_id, turn, i, role, text, c,
         CASE WHEN signs = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN signs[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS both_ FROM numbered),
walk(before_, edits, mid) AS (VALUES
  (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3),
  (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)),
way AS (
  SELECT before_, 'D' AS edits, before_ AS after_, 2 AS cost, '' AS need FROM walk WHERE edits = ''
  UNION ALL SELECT before_, edits || 'K', CASE WHEN mid = 2 THEN 3 ELSE 2 END, 5 * length(edits),
                   CASE WHEN mid = 2 THEN 'a' ELSE 'u' END FROM walk
  UNION ALL SELECT before_, edits || 'K', 1, 5 * length(edits), 's' FROM walk WHERE mid = 0
  UNION ALL SELECT before_, edits || 'R', CASE WHEN mid = 2 THEN 3 ELSE 2 END,
                   5 * length(edits) + 1, '' FROM walk),
dp(conv_id, i, state, cost, audit, out) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, 0, '', CAST([] AS VARCHAR[]) FROM r WHERE i = 1
  UNION ALL
  SELECT dp.conv_id, r.i, way.after_,
         dp.cost + way.cost + CASE WHEN fault = 'truncated' AND way.edits <> 'D' THEN 5 ELSE 0 END,
         dp.audit || way.edits,
         CASE WHEN way.edits = 'D' THEN out ELSE list_concat(out, list_concat(
           CASE WHEN length(way.edits) > 1 THEN
             [CASE WHEN dp.state = 2 THEN 'assistant:' ELSE 'user:' END,
              CASE WHEN dp.state = 2 THEN 'user:' ELSE 'assistant:' END][1:length(way.edits) - 1]
             ELSE [] END,
           [CASE WHEN way.edits LIKE '%K' THEN role WHEN way.after_ = 2 THEN 'user' ELSE 'assistant' END
            || ':' || text])) END
  FROM dp JOIN r ON r.conv_id = dp.conv_id AND r.i = dp.i + 1
  JOIN way ON way.before_ = dp.state AND (way.edits = 'D' OR fault NOT IN ('blank', 'duplicate'))
          AND (way.need = '' OR way.need = c)
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id, way.after_ ORDER BY
    dp.cost + way.cost + CASE WHEN fault = 'truncated' AND way.edits <> 'D' THEN 5 ELSE 0 END,
    dp.audit || way.edits) = 1),
ended AS (
  SELECT * FROM (SELECT conv_id, cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost,
         audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
         list_concat(out, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:']
                          ELSE [] END) AS out
  FROM dp JOIN (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id) USING (conv_id) WHERE i = n)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (both_ NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN told USING (conv_id)
LEFT JOIN ended USING (conv_id)
"""

OP13 = r"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT row_number() OVER w AS row_, doc_id, t, lead(t) OVER w AS after_
      FROM o WINDOW w AS (ORDER BY doc_id NULLS FIRST, md5(t))),
e AS (SELECT row_, doc_id, t, coalesce(after_, (SELECT t FROM s WHERE row_ = 1)) AS after_ FROM s),
x AS (SELECT row_, doc_id, t,
             left(t, CAST(length(t) - length(t) // 2 AS BIGINT)) || left(after_, CAST(length(t) // 2 AS BIGINT)) AS u FROM e),
w AS (SELECT row_, kind, regexp_extract_all(translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM (SELECT row_, 0 AS kind, t AS y FROM x UNION ALL SELECT row_, 1, u FROM x)),
p AS (SELECT row_, kind, unnest(ws) AS a, unnest(list_concat(ws[2:], [NULL])) AS b FROM w),
c AS (SELECT row_, kind, a, b, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT row_, kind, sha256(a) AS x, NULL AS y, n * strlen(a) AS weight FROM c
      UNION ALL
      SELECT row_, kind, sha256(a), sha256(b), n * (strlen(a) + strlen(b)) FROM c
      WHERE b IS NOT NULL),
d AS (SELECT row_, kind, weight, at_, xor(strpos('123456789abcdef', substr(x, at_, 1)),
             CASE WHEN y IS NULL THEN 0
                  ELSE strpos('123456789abcdef', substr(y, (at_ + 31) % 64 + 1, 1)) END) AS v
      FROM h CROSS JOIN (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS at_)),
v AS (SELECT row_, kind, at_,
             CASE WHEN sum(CASE WHEN v & 8 > 0 THEN weight ELSE -weight END) > 0 THEN 8 ELSE 0 END
             + CASE WHEN sum(CASE WHEN v & 4 > 0 THEN weight ELSE -weight END) > 0 THEN 4 ELSE 0 END
             + CASE WHEN sum(CASE WHEN v & 2 > 0 THEN weight ELSE -weight END) > 0 THEN 2 ELSE 0 END
             + CASE WHEN sum(CASE WHEN v & 1 > 0 THEN weight ELSE -weight END) > 0 THEN 1 ELSE 0 END
             AS digit FROM d GROUP BY ALL),
f AS (SELECT row_, kind, string_agg(substr('0123456789abcdef', digit + 1, 1), '' ORDER BY at_) AS print,
             list(digit ORDER BY at_) AS digits FROM v GROUP BY ALL),
g AS (SELECT x.row_, x.doc_id, length(t) AS n_chars, sha256(u) AS edited_sha256,
             coalesce(a.print, repeat('0', 64)) AS fingerprint,
             coalesce(b.print, repeat('0', 64)) AS edited_fingerprint,
             coalesce(a.digits, list_transform(range(64), lambda i: 0)) AS one,
             coalesce(b.digits, list_transform(range(64), lambda i: 0)) AS two
      FROM x LEFT JOIN f a ON a.row_ = x.row_ AND a.kind = 0
             LEFT JOIN f b ON b.row_ = x.row_ AND b.kind = 1),
r AS (SELECT g.*, coalesce(n.one, z.one) AS three FROM g LEFT JOIN g n ON n.row_ = g.row_ + 1
      JOIN g z ON z.row_ = 1),
near_ AS (SELECT g.row_, count(*) - 1 AS n_within FROM g JOIN g o ON list_sum(list_transform(
            list_zip(g.one, o.one), lambda q: bit_count(xor(q[1], q[2])))) <= 7
          WHERE g.doc_id % 100 = 0 GROUP BY g.row_)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       1 - list_sum(list_transform(list_zip(one, two), lambda q: bit_count(xor(q[1], q[2])))) / 256 AS near_edited,
       1 - list_sum(list_transform(list_zip(one, three), lambda q: bit_count(xor(q[1], q[2])))) / 256 AS near_next,
       n_within
FROM r LEFT JOIN near_ ON near_.row_ = r.row_
"""
