"""Queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import op11_collocations
from .conversations import op12_conversations
from .decontaminate import op10_decontaminate
from .exact_dedup import op2_exact_dedup
from .licenses import op1_license_scan
from .near_dedup import op3_near_dedup
from .oracles import OP11, OP12, OP13
from .packing import op4_packing
from .quality import op6_quality
from .sharding import LIMIT_BYTES, op5_sharding
from .simhash import op13_simhash
from .substrings import op8_substring_dedup
from .token_files import op9_token_files
from .toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan, op2_exact_dedup, op3_near_dedup, op4_packing, op5_sharding, op6_quality,
        op7_toxicity, op8_substring_dedup, op9_token_files, op10_decontaminate,
        op11_collocations, op12_conversations, op13_simhash)}

# ASCII white space, and runs of other characters than those in the class.
_SPACE_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP3 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_SPACE_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE
    WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)]) END AS ss
  FROM w),
n AS (SELECT doc_id, len(ss) AS k FROM s),
e AS (SELECT doc_id, unnest(ss) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM e a JOIN e b
      ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * both_ >= 80 * (x.k + y.k - both_)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, node) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.node)
SELECT n.doc_id, CAST(n.k AS BIGINT) AS n_shingles, c.component_id,
       n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

OP5 = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0')
           AS bits
  FROM documents),
p AS (SELECT doc_id, n_bytes, substr(bits, 1, len_) AS shard, len_
      FROM d CROSS JOIN (SELECT unnest(range(0, 25)) AS len_)),
g AS (SELECT shard, len_, count(*) AS shard_docs, sum(n_bytes) AS shard_bytes FROM p
      GROUP BY shard, len_),
c AS (SELECT p.doc_id, p.n_bytes, p.shard, g.shard_docs, g.shard_bytes,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY p.len_) AS k
      FROM p JOIN g ON p.shard = g.shard AND p.len_ = g.len_
      WHERE g.shard_bytes <= {LIMIT_BYTES} OR g.shard_docs = 1)
SELECT doc_id, n_bytes, shard, shard_docs, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM c WHERE k = 1
"""

OP8 = f"""
WITH w AS (SELECT doc_id, {_SPACE_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM x),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at_ FROM r WHERE k > 1),
g AS (SELECT doc_id, list(at_) AS gone FROM h GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(gone, CAST([] AS BIGINT[])) AS gone
      FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
f AS (
  SELECT doc_id, len(ws) AS n, len(gone) AS m,
         array_to_string([y.w for y in list_zip(ws, range(1, len(ws) + 1))
                          if NOT list_contains(gone, y.i)], ' ') AS kept
  FROM (SELECT doc_id, ws, gone FROM k))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed,
       sha256(kept) AS kept_sha256
FROM f
"""
OP8 = OP8.replace("y.w for y", "y[1] for y").replace("gone, y.i", "gone, y[2]")

OP10 = f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws
           FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             {_ALNUM_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
        SELECT item_id, ws, least(10, len(ws)) AS n,
               unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
        FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM v),
x AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
        SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM d CROSS JOIN sizes WHERE len(ws) >= n)),
m AS (SELECT x.doc_id, x.i, x.n, v.item_id FROM x JOIN v ON x.n = v.n AND x.win = v.win),
hits AS (SELECT doc_id, count(DISTINCT at_) AS n_hit FROM (
           SELECT doc_id, unnest(range(i, i + n)) AS at_ FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

ORACLES: dict[str, str] = {
    "op2_exact_dedup": OP2, "op3_near_dedup": OP3, "op5_sharding": OP5,
    "op8_substring_dedup": OP8, "op10_decontaminate": OP10,
    "op11_collocations": OP11, "op12_conversations": OP12, "op13_simhash": OP13}
