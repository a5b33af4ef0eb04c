"""The corpus operators' queries over the test tables, and DuckDB SQL for those that SQL can express."""
from __future__ import annotations

from oddsmill.llm import bpe, divergence, jpeg, katz, licenses, mixing, pii, quality, simhash, substrings, tokenfiles, warc, whitening


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_pii": pii.query,
        "op2_warc": warc.query,
        "op3_byte_bpe": bpe.query,
        "op4_simhash": simhash.query,
        "op5_media": jpeg.query,
        "op6_substring_dedup": substrings.query,
        "op7_quality_rules": quality.query,
        "op8_mixing": mixing.query,
        "op9_token_files": tokenfiles.query,
        "op10_license_scan": licenses.query,
        "op11_source_divergence": divergence.query,
        "op12_katz_scores": katz.query,
        "op13_whitening": whitening.query,
        "pipeline": _pipeline,
    }


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS best FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN best IS NOT NULL AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""

MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM s2),
s4 AS (SELECT *, CAST(greatest(1, least(4096, floor(target / 256))) AS BIGINT) AS block FROM s3),
s5 AS (SELECT *, (source_size + block - 1) // block AS blocks, target / block AS wanted FROM s4),
s6 AS (SELECT *, sum(wanted) OVER (ORDER BY sid) / nullif(sum(wanted) OVER (), 0) AS hi, CAST(round(sum(wanted) OVER ()) AS BIGINT) AS slots FROM s5),
s AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo FROM s6),
u AS (SELECT i, ((i % 2147483648) * 2654435769 % 4294967296) / 4294967296.0::DOUBLE AS u FROM range((SELECT max(slots) FROM s)) r(i)),
drawn AS (SELECT sid, block, blocks, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS r FROM u JOIN s ON u.u >= s.lo AND u.u < s.hi),
uses AS (SELECT sid, r % blocks AS b, count(*) AS uses FROM drawn WHERE r < 3 * blocks GROUP BY ALL),
placed AS (SELECT d.doc_id, d.size, s.sid, s.source_size, s.target, s.block,
           CAST(sum(d.size) OVER (PARTITION BY s.sid ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
           FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT *, unnest(range((e - size) // block, (e - 1) // block + 1)) AS b FROM placed WHERE size > 0),
taken AS (SELECT sid, e, sum((least(e, (p.b + 1) * block) - greatest(e - size, p.b * block)) * uses) AS t FROM pieces p JOIN uses USING (sid, b) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN coalesce(t, 0) ELSE 0 END AS BIGINT) AS taken
FROM placed LEFT JOIN taken USING (sid, e)
"""


SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
windows AS (SELECT r, doc_id, s, array_to_string(w[s:s + 12], ' ') AS g FROM starts),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS i FROM windows JOIN firsts USING (g) WHERE first < doc_id),
places AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM places ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
own AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * v) AS p
        FROM groups g JOIN kept k USING (lang) JOIN vs USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
whole AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 5) // (any_value(l.total) + 5 * any_value(v)) AS q
          FROM c JOIN vs USING (lang) JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) l USING (lang) GROUP BY lang, term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
         LEFT JOIN far f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (FROM pair UNION ALL FROM term) QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": DIVERGENCE_SQL, "op6_substring_dedup": SUBSTRING_SQL, "op2_warc": WARC_SQL, "op8_mixing": MIXING_SQL}
