"""SQL twins of the queries that SQL can express; DuckDB runs them on the same tables."""

from __future__ import annotations

from scoutgrid.llm.quality_rules import STOP_WORDS, spelled

_WORD = r"'[^\x20\x09-\x0D]+'"

_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, {_WORD}) AS ws,
             list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
x AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
p AS (SELECT rid, i, {' || chr(10) || '.join(f"lead(x, {k}) OVER o" for k in range(8))} AS s FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM p WHERE s IS NOT NULL),
r AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS k FROM g WHERE n > 1),
c AS (SELECT rid, sum(k) AS n_repeat FROM r GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: x IN ({', '.join(f"'{s}'" for s in spelled(STOP_WORDS))}))) AS n_stop
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 30 * n_words
       AND 100 * n_stop BETWEEN 2 * n_words AND 100 * n_words AND 100 * n_dup_lines <= 40 * n_lines AS kept
FROM b"""

_URLS = """
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
n AS (SELECT row_number() OVER () AS rid, * FROM s),
f AS (SELECT rid, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(v, length(rule_host || rule_path)) AS v
      FROM n JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM n LEFT JOIN f USING (rid)"""

_ESC = r"replace(replace(replace({0}, '\', '\e'), '<', '\l'), '[', '\b')"

_CHAT = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
           SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n)) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(replace({_ESC.format('role')}, chr(10), '\\n')) + 1 + length({_ESC.format('text')})
                + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

_JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b USING (h) WHERE a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid AS x, rid AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT r.x AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY r.x),
k AS (SELECT x AS rid, count(*) AS n_links FROM e GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid) LEFT JOIN k USING (rid)"""

_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda a, b:
  list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), CAST(4294967295 AS BIGINT)))"""

_MERKLE = f"""
WITH RECURSIVE f AS (SELECT doc_id, source, text, {' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', 'n_chars')))} AS head,
  CASE WHEN coalesce({_CRC}, 0) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS claimed FROM documents),
h AS (SELECT doc_id, source, sha256(head || {_FIELD('text')}) AS leaf, sha256(head || {_FIELD('claimed')}) AS claim FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
             row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid FROM h),
a AS (SELECT t, 0 AS lvl, i, leaf AS digest, n FROM n
      UNION ALL SELECT t, lvl + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM a WHERE n > 1 GROUP BY t, lvl, i // 3, n),
s AS (SELECT t, digest, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (SELECT 0 AS lvl, t AS i, digest, n FROM s
      UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM b WHERE n > 1 GROUP BY lvl, i // 3, n),
k AS (SELECT rid, t, 0 AS lvl, i, claim AS acc, '' AS proof, n > 1 AS more FROM n
      UNION ALL
      SELECT k.rid, k.t, k.lvl + 1, k.i // 3, sha256(string_agg(CASE WHEN a.i = k.i THEN k.acc ELSE a.digest END, '' ORDER BY a.i)),
             k.proof || coalesce(string_agg(CASE WHEN a.i = k.i THEN '' ELSE a.digest END, '' ORDER BY a.i), ''), any_value(a.n) > 3
      FROM k JOIN a ON a.t = k.t AND a.lvl = k.lvl AND a.i // 3 = k.i // 3 WHERE k.more GROUP BY k.rid, k.t, k.lvl, k.i, k.acc, k.proof),
u AS (SELECT rid, 0 AS lvl, t AS i, acc, proof, (SELECT count(*) FROM s) > 1 AS more FROM k WHERE NOT more
      UNION ALL
      SELECT u.rid, u.lvl + 1, u.i // 3, sha256(string_agg(CASE WHEN b.i = u.i THEN u.acc ELSE b.digest END, '' ORDER BY b.i)),
             u.proof || coalesce(string_agg(CASE WHEN b.i = u.i THEN '' ELSE b.digest END, '' ORDER BY b.i), ''), any_value(b.n) > 3
      FROM u JOIN b ON b.lvl = u.lvl AND b.i // 3 = u.i // 3 WHERE u.more GROUP BY u.rid, u.lvl, u.i, u.acc, u.proof)
SELECT z.doc_id, z.leaf, s.digest AS subroot, r.digest AS root, sha256(u.proof) AS proof_sha256, u.acc AS folded_root, u.acc = r.digest AS verified
FROM n z JOIN u ON u.rid = z.rid AND NOT u.more JOIN s ON s.t = z.t, (SELECT digest FROM b WHERE n = 1) r"""

_SHARE = lambda n, total, v: f"(1 + CAST(1000000000 AS HUGEINT) * ({n} + 1) // ({total} + {v}))"

_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE("coalesce(c.n, 0)", "coalesce(s.total, 0)", "l.v")} AS p,
             {_SHARE("k.lang_n", "l.total", "l.v")} AS q
      FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
           LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
      FROM m x JOIN m y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
f AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM m WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM b UNION ALL SELECT * FROM f))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200"""

ORACLES: dict[str, str] = {"op3_jaccard_join": _JACCARD, "op4_quality_rules": _QUALITY, "op5_url_filter": _URLS, "op10_chat_format": _CHAT, "op11_source_divergence": _DIVERGENCE,
                           "op13_merkle_manifest": _MERKLE}
