"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.llm import (
    dart_minhash,
    decontaminate,
    deep_shallow,
    language,
    merkle,
    mixture,
    quality,
    quality_rules,
    suffix_tree,
    toxicity,
    url_filter,
    warc,
    whitening,
)
from shelfcast.llm.tables import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]


@query
def op1_decontamination(spark, root):
    found = decontaminate.contamination(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated"
    )


ORACLE["op1_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op6_substring_dedup(spark, root):
    kept = suffix_tree.drop_repeats(table(spark, root, "documents"), ["doc_id", "text"])
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE["op6_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (k)),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT word.r, string_agg(word, ' ' ORDER BY word.p) AS kept, count(*) AS n
  FROM word LEFT JOIN gone ON word.r = gone.r AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@query
def op7_suffix_array_dedup(spark, root):
    kept = deep_shallow.drop_repeated_bytes(table(spark, root, "documents"), ["doc_id"], with_kept=False, with_text=True)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


ORACLE["op7_suffix_array_dedup"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, encode(coalesce(text, '')) AS h FROM documents),
byte AS MATERIALIZED (
  SELECT r, p, hex(h[p:p]) AS b, CASE WHEN p <= n - 399 THEN md5(h[p:p + 399]) END AS k
  FROM (SELECT r, n, h, unnest(range(1, n + 1)) AS p FROM d)),
rep AS (SELECT k FROM byte WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
marked AS (
  SELECT r, p, b, coalesce(p - max(CASE WHEN rep.k IS NOT NULL THEN p END) OVER w < 400, false) AS gone,
    sum(CASE WHEN b BETWEEN '80' AND 'BF' THEN 0 ELSE 1 END) OVER w AS c
  FROM byte LEFT JOIN rep USING (k) WINDOW w AS (PARTITION BY r ORDER BY p)),
spans AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS first FROM marked),
hurt AS (SELECT r, c FROM marked GROUP BY r, c HAVING bool_or(gone)),
sums AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS kept,
    string_agg(b, '' ORDER BY p) FILTER (hurt.c IS NULL) AS whole
  FROM spans LEFT JOIN hurt USING (r, c) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256, decode(unhex(coalesce(whole, ''))) AS text
FROM d LEFT JOIN sums USING (r)
"""


@query
def op10_near_dedup(spark, root):
    return dart_minhash.near_duplicates(table(spark, root, "documents")).select("doc_id", "class_id", "class_size")


ORACLE["op10_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
ws AS MATERIALIZED (SELECT r, s, count(*) AS n FROM sh GROUP BY r, s),
tot AS (SELECT r, sum(n) AS n FROM ws GROUP BY r),
shared AS (SELECT x.r AS a, y.r AS b, sum(least(x.n, y.n)) AS n FROM ws x JOIN ws y ON x.s = y.s AND x.r < y.r GROUP BY 1, 2),
link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN tot ta ON ta.r = a JOIN tot tb ON tb.r = b WHERE shared.n >= 0.8 * (ta.n + tb.n - shared.n)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(r, s) AS (SELECT r, r FROM d UNION SELECT reach.r, b FROM reach JOIN both_ways ON a = s),
named AS (SELECT r, min(s) AS c FROM reach GROUP BY r)
SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS class_id, count(*) OVER (PARTITION BY c) AS class_size
FROM named JOIN d USING (r)
"""


@query
def op2_quality_classifier(spark, root):
    return quality.judged(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op3_toxicity(spark, root):
    return toxicity.judged(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op4_url_filter(spark, root):
    return url_filter.judged(table(spark, root, "pages"))


@query
def op9_quality_rules(spark, root):
    return quality_rules.judged(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op5_warc(spark, root):
    return warc.round_trip(table(spark, root, "pages"))


ORACLE["op5_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, h, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
  (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::INTEGER >> (15 - 5 * (k % 4))) & 31)], '' ORDER BY k)
    FROM range(32) AS t(k)) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM x
"""


@query
def op8_source_mixing(spark, root):
    mix = mixture.mixed(table(spark, root, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op11_whitening(spark, root):
    return whitening.components(table(spark, root, "embeddings"))


@query
def op12_merkle(spark, root):
    return merkle.verified(table(spark, root, "documents"))


ORACLE["op12_merkle"] = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, *, doc_id::VARCHAR AS id FROM documents),
crc(r, s, id, c) AS (
  SELECT r, 0, id, 4294967295::BIGINT FROM f WHERE id IS NOT NULL
  UNION ALL
  SELECT r, s + 1, id, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT r, s, id, CASE WHEN s % 8 = 0 THEN xor(c, ascii(id[s // 8 + 1])) ELSE c END AS x FROM crc WHERE s < 8 * len(id))),
even AS (SELECT r FROM crc WHERE s = 8 * len(id) AND c & 1 = 1),
pre AS (
  SELECT f.r, doc_id, source, concat(CASE WHEN id IS NULL THEN '-' ELSE strlen(id) || ':' || id END,
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    text, CASE WHEN even.r IS NULL THEN text ELSE replace(text, chr(10), '') END AS changed
  FROM f LEFT JOIN even USING (r)),
leaves AS MATERIALIZED (
  SELECT r, doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN changed IS NULL THEN '-' ELSE strlen(changed) || ':' || changed END) AS seen FROM pre),
up(source, lvl, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY doc_id NULLS FIRST, leaf) FROM leaves GROUP BY source
  UNION ALL
  SELECT source, lvl + 1, [sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')) FOR i IN range((len(nodes) + 2) // 3)]
  FROM up WHERE len(nodes) > 1),
sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p FROM up WHERE len(nodes) = 1),
top(lvl, nodes) AS (
  SELECT 0, list(subroot ORDER BY p) FROM sub
  UNION ALL
  SELECT lvl + 1, [sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')) FOR i IN range((len(nodes) + 2) // 3)]
  FROM top WHERE len(nodes) > 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
steps AS (
  SELECT r, lvl, nodes, p // (3 ** lvl)::BIGINT AS own FROM placed JOIN up ON placed.source IS NOT DISTINCT FROM up.source WHERE len(nodes) > 1
  UNION ALL
  SELECT r, 1000 + lvl, nodes, sub.p // (3 ** lvl)::BIGINT FROM placed JOIN sub ON placed.source IS NOT DISTINCT FROM sub.source, top WHERE len(nodes) > 1),
around AS (
  SELECT r, lvl, array_to_string(nodes[own - own % 3 + 1:own], '') AS l, array_to_string(nodes[own + 2:own - own % 3 + 3], '') AS g FROM steps),
paths AS (SELECT r, list(l || '*' || g ORDER BY lvl) AS path, string_agg(l || g, '' ORDER BY lvl) AS proof FROM around GROUP BY r),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_concat([seen], coalesce(path, [])), lambda d, s: sha256(replace(s, '*', d))) AS folded_root
  FROM placed JOIN sub ON placed.source IS NOT DISTINCT FROM sub.source LEFT JOIN paths USING (r))
SELECT *, folded_root = root AS verified FROM done
"""


@query
def op13_language_id(spark, root):
    return language.judged(table(spark, root, "documents"))
