"""DuckDB SQL for the queries that it can express over whole tables."""

from __future__ import annotations

from graphloom.llm import decontaminate, middle, secrets, substrings

SUBSTRINGS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {substrings.WINDOW - 1}], ' ') AS words
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substrings.WINDOW - 2})) AS i FROM d)),
r AS (SELECT words FROM k GROUP BY words HAVING count(*) > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + o.range AS place FROM k SEMI JOIN r USING (words), range({substrings.WINDOW}) o),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS words FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d) ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""


def _words(table: str, key: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


DECONTAMINATE = f"""
WITH d AS MATERIALIZED ({_words('documents', 'doc_id')}),
b AS MATERIALIZED (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS n FROM ({_words('benchmark', 'item_id')}) WHERE len(w) > 0),
x AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM x),
k AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hit AS MATERIALIZED (SELECT doc_id, k.n, i, item_id FROM k JOIN x ON x.n = k.n AND x.words = k.words),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _spans(rank: int, rule: secrets.Rule) -> str:
    """Matches and the parts between them add up to the places."""
    pattern = rule.pattern.replace("'", "''")
    kept = f"length(m[i]) >= {rule.length}" + (f" AND length(regexp_extract(m[i], '{pattern}', 1)) >= {rule.group_length}" if rule.group_length else "")
    at = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {rank} AS rank, '{rule.name}' AS kind, CAST({at} AS BIGINT) AS place, CAST({at} + length(m[i]) AS BIGINT) AS upto FROM (
        SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)) WHERE {kept}"""


SECRETS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED ({' UNION ALL '.join(_spans(k, r) for k, r in enumerate(secrets.RULES))}),
j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || place || ':' || upto, ',' ORDER BY place, rank, upto) FILTER (rank < {len(secrets.BASE_RULES)}) AS base,
    string_agg(kind || ':' || place || ':' || upto, ',' ORDER BY place, rank, upto) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)
"""

_P, _S, _M = middle.Marks()
MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS z, ('0x' || h[25:32])::BIGINT % 100 AS w FROM d),
f AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN t = '' OR contains(t, '{_P}') OR contains(t, '{_S}') OR contains(t, '{_M}') OR z >= {middle.TRANSFORMED} THEN 'plain' WHEN w < {middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, substring(t, 1, a) AS head, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS rest FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{_P}' || head || '{_S}' || rest || '{_M}' || mid ELSE '{_S}' || rest || '{_P}' || head || '{_M}' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
