"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM n
"""



def _division(nodes: str, parent: str, order: str, out: str, given: str) -> str:
    """Common tables that divide ``given`` among the children in ``nodes``."""
    by = f"PARTITION BY {parent} " if parent else ""
    return f"""
  {out}_s AS (
    SELECT *, CAST(capacity AS DOUBLE) / weight AS rate,
           {given} - coalesce(sum(capacity) OVER ({by}ORDER BY CAST(capacity AS DOUBLE) / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(weight) OVER ({by}ORDER BY CAST(capacity AS DOUBLE) / weight, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares,
           row_number() OVER ({by}ORDER BY CAST(capacity AS DOUBLE) / weight, {order}) AS place
    FROM {nodes}),
  {out}_c AS (
    SELECT *, min(CASE WHEN CAST(rest AS HUGEINT) * weight < CAST(capacity AS HUGEINT) * shares THEN place END) OVER ({by or ''}) AS cut
    FROM {out}_s),
  {out} AS (
    SELECT a.*, CASE WHEN a.cut IS NULL OR a.place < a.cut THEN a.capacity
                     ELSE greatest(0, least(a.capacity, CAST(CAST(b.rest AS HUGEINT) * a.weight // CAST(b.shares AS HUGEINT) AS BIGINT))) END AS budget
    FROM {out}_c a LEFT JOIN {out}_c b ON a.cut = b.place {''.join(f" AND a.{c.strip()} IS NOT DISTINCT FROM b.{c.strip()}" for c in parent.split(",") if c.strip())})"""


_DOMAIN = "CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS BIGINT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END"
_DOMAIN_WEIGHT = "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END"
_LANG_WEIGHT = "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END"
_LEAF = "a.domain = b.domain AND a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source"

OP7 = f"""
WITH d AS (
    SELECT doc_id, lang, source, {_DOMAIN} AS domain,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
    FROM documents),
  l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS capacity, 1 AS weight FROM d GROUP BY ALL),
  t AS (SELECT CAST(sum(n_tokens) * 3 // 5 AS BIGINT) AS target FROM d),
  n1 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, {_DOMAIN_WEIGHT} AS weight, any_value(t.target) AS target FROM l, t GROUP BY domain),
  {_division("n1", "", "domain", "b1", "target").strip()},
  n2 AS (SELECT l.domain, lang, sum(l.capacity)::BIGINT AS capacity, {_LANG_WEIGHT} AS weight, any_value(b1.budget) AS given FROM l JOIN b1 ON l.domain = b1.domain GROUP BY l.domain, lang),
  {_division("n2", "domain", "lang", "b2", "given").strip()},
  n3 AS (SELECT l.*, b2.budget AS given FROM l JOIN b2 ON l.domain = b2.domain AND l.lang IS NOT DISTINCT FROM b2.lang),
  {_division("n3", "domain, lang", "source", "b3", "given").strip()},
  p AS (
    SELECT a.*, b.budget AS leaf_budget, CASE WHEN b.capacity > 0 THEN b.budget // b.capacity ELSE 0 END AS epochs, b.capacity
    FROM d a JOIN b3 b ON {_LEAF}),
  q AS (
    SELECT *, leaf_budget - epochs * capacity AS left_over,
           CAST(('0x' || substr(md5('11:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) AS place
    FROM p),
  r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id) AS run FROM q),
  f AS (SELECT *, bool_or(run > left_over) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id) AS beyond FROM r)
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget,
       CAST(epochs + CASE WHEN left_over > 0 AND NOT beyond THEN 1 ELSE 0 END AS BIGINT) AS n_copies
FROM f
"""



_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""
WITH RECURSIVE
  t AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
  w AS (SELECT doc_id, len(ws) AS n_words, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
  v AS (
    SELECT doc_id, n_words, pos, string_agg(word, ' ') OVER f AS shingle, count(*) OVER f AS width
    FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM v WHERE width = 5 OR (n_words < 5 AND pos = 1)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS MATERIALIZED (SELECT a, b, k = x.n AND k = y.n AS equal FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
  c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id),
  k AS (SELECT d.doc_id, coalesce(min(l.a), d.doc_id) AS class FROM documents d LEFT JOIN l ON l.b = d.doc_id AND l.equal GROUP BY d.doc_id),
  g AS (SELECT x.class, count(DISTINCT y.class) AS n_links FROM e JOIN k x ON e.a = x.doc_id JOIN k y ON e.b = y.doc_id WHERE x.class <> y.class GROUP BY x.class)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(g.n_links, 0) AS n_links
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id JOIN k ON d.doc_id = k.doc_id LEFT JOIN g ON k.class = g.class
"""

OP6 = f"""
WITH t AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
  w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
  v AS (
    SELECT doc_id, pos, word, md5(string_agg(word, ' ') OVER f) AS h, count(*) OVER f AS width
    FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
  c AS (SELECT doc_id, pos, word, CASE WHEN width = 35 AND count(*) OVER (PARTITION BY h, width) > 1 THEN 1 ELSE 0 END AS again FROM v),
  m AS (SELECT doc_id, pos, word, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c)
SELECT d.doc_id, count(m.word) AS n_words, CAST(coalesce(sum(m.gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.pos) FILTER (WHERE m.gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""


OP11 = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS txt FROM documents),
  w AS (SELECT *, {_WORDS.format(text="txt")} AS ws FROM t),
  v AS (
    SELECT doc_id, part,
           CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
           || CASE WHEN 100 * length(regexp_replace(txt, '[^A-Z]', '', 'g')) > 3 * length(txt) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(txt, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN min(doc_id) OVER (PARTITION BY txt) < doc_id THEN 'E' ELSE '' END AS fails
    FROM w),
  k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
  c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM v LEFT JOIN k ON v.doc_id = k.doc_id GROUP BY part, fails),
  x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
  o AS (
    SELECT x1.f || x2.f || x3.f || x4.f || x5.f AS filter_order FROM x x1, x x2, x x3, x x4, x x5
    WHERE x2.f <> x1.f AND x3.f NOT IN (x1.f, x2.f) AND x4.f NOT IN (x1.f, x2.f, x3.f) AND x5.f NOT IN (x1.f, x2.f, x3.f, x4.f)),
  s AS (SELECT filter_order, CAST(i AS INT) AS step, substr(filter_order, i, 1) AS f, substr(filter_order, 1, i - 1) AS before FROM o, range(1, 6) r(i)),
  r AS (
    SELECT part, filter_order, step, f,
           coalesce(sum(n) FILTER (translate(fails, before || f, '') = fails), 0) AS kept,
           coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0) AS removed,
           coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') <> fails), 0) AS redundant,
           coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
           coalesce(sum(good) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0) AS toxic_lost
    FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""

#: CRC-32 of the decimal id by one bit or byte a step; prefixes are chains of digests.
OP12 = f"""
WITH RECURSIVE
  o AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key, len({_WORDS.format(text="coalesce(text, '')")}) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS digits FROM o GROUP BY conv_id),
  z(conv_id, digits, k, crc) AS (
    SELECT conv_id, digits, 0, CAST(4294967295 AS BIGINT) FROM c
    UNION ALL
    SELECT conv_id, digits, k + 1,
           CASE WHEN k % 9 = 0 THEN xor(crc, CAST(ascii(substr(digits, k // 9 + 1, 1)) AS BIGINT))
                WHEN crc % 2 = 1 THEN xor(crc // 2, CAST(3988292384 AS BIGINT)) ELSE crc // 2 END
    FROM z WHERE k < 9 * length(digits)),
  h AS (SELECT conv_id, xor(crc, CAST(4294967295 AS BIGINT)) % 4 AS h FROM z WHERE k = 9 * length(digits)),
  b AS (
    SELECT c.conv_id, h.h, c.conv_id - c.conv_id % 20 AS base, least(h.h, coalesce(d.n, 0)) AS lent
    FROM c JOIN h ON c.conv_id = h.conv_id LEFT JOIN c d ON d.conv_id = c.conv_id - c.conv_id % 20),
  r AS (
    SELECT b.conv_id, o.pos AS depth, turn_key, words FROM b JOIN o ON o.conv_id = b.base AND o.pos <= b.lent
    UNION ALL
    SELECT b.conv_id, b.lent + o.pos - b.h, turn_key, words FROM b JOIN o ON o.conv_id = b.conv_id AND o.pos > b.h),
  p AS (
    SELECT conv_id, depth, words, string_agg(turn_key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM r
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM b),
  n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY depth, k),
  e AS (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id),
  f AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM e GROUP BY k),
  g AS (SELECT left(k, CAST(32 * (depth - 1) AS BIGINT)) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
  u AS (SELECT n.k, n.depth, n.n_convs, n.words, coalesce(g.n_children, 0) AS n_children, unnest(range(0, n.depth + 1)) AS above FROM n LEFT JOIN g ON n.k = g.k),
  s AS (SELECT left(k, CAST(32 * above AS BIGINT)) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM u GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(g.n_children, 0) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM n JOIN s ON n.k = s.k LEFT JOIN g ON n.k = g.k LEFT JOIN f ON n.k = f.k
LEFT JOIN n q ON n.depth > 0 AND q.k = left(n.k, CAST(32 * (n.depth - 1) AS BIGINT))
"""

OP13 = OP5[: OP5.index("  k AS (SELECT")].rstrip().rstrip(",").replace(">= 75 *", ">= 85 *") + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": OP3,
        "op5_ngram_jaccard_join": OP5,
        "op6_substring_dedup": OP6,
        "op7_mixing": OP7,
        "op11_filter_audit": OP11,
        "op12_prefix_trie": OP12,
        "op13_minhash_dedup": OP13,
    }
