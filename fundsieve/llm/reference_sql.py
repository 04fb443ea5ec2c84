"""SQL for the results of operators 1, 3 and 6, by plain definitions instead of the operators' methods."""

from __future__ import annotations

from .secrets import BASE_RULES, MORE_RULES, quick

#: The base kinds, written out: kind, expression, least length of the group, group. Runs that are dropped for their
#: length are not matched.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", "AKIA[A-Z0-9]+", 20, 0),
    ("hex", "[0-9a-f]{24,}", 24, 0),
)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secret_spans() -> str:
    """Places of all matches from the lengths of what lies between them."""
    parts = []
    for k, (kind, expression, least, group) in enumerate(BASE + tuple((kind, quick(x, n, g), n, g) for kind, x, n, g in MORE_RULES)):
        e = quoted(expression)
        parts.append(
            f"""SELECT rid, {k} AS k, {quoted(kind)} AS kind, start, start + len(m) AS stop FROM (
            SELECT rid, m, g, sum(len(p)) OVER w + coalesce(sum(len(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM (SELECT rid, unnest(regexp_split_to_array(text, {e})) AS p, unnest(regexp_extract_all(text, {e}, 0)) AS m, unnest(regexp_extract_all(text, {e}, {group})) AS g, unnest(range(length(text) + 1)) AS i FROM d WHERE regexp_matches(text, {e}))
            WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE m IS NOT NULL AND len(g) >= {least}"""
        )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {quoted(r[0])}) AS n_{r[0]}" for r in BASE_RULES)
    kinds = ", ".join(quoted(r[0]) for r in BASE_RULES)
    said = "kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k, stop"
    zero = ", ".join(f"coalesce(n_{r[0]}, 0)::BIGINT AS n_{r[0]}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), s AS ({" UNION ALL ".join(parts)}),
    a AS (SELECT rid, {counts}, coalesce(string_agg({said}) FILTER (WHERE kind IN ({kinds})), '') AS base, string_agg({said}) AS spans FROM s GROUP BY rid)
    SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


#: Every window of 100 bytes, numbered among its equals; runs of the later ones are cut out.
REPEATED_BYTES = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), s AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY b[i + 1 : i + 100] ORDER BY doc_id, i) AS k FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS i FROM s)),
f AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM w WHERE k > 1)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM f GROUP BY doc_id, run),
g AS (SELECT doc_id, a AS cut, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, n, n FROM s)),
k AS (SELECT g.doc_id, unhex(coalesce(string_agg(hex(b[since + 1 : cut]), '' ORDER BY since), '')) AS kept FROM g JOIN s USING (doc_id) GROUP BY g.doc_id),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(kept) AS kept_sha256 FROM s JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: All pairs and their transitive reach.
EMBEDDING_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
