"""DuckDB SQL for those of the registered queries that SQL can express.

Sharding and mixing rest on hashes that SQL doesn't have, packing and token counts
on tokenizers, quality on a fitted model; they are tested against brute force.
"""

from __future__ import annotations

from .license_scan import LOWER, UPPER, templates
from .url_filter import RULES

_VECTOR = "vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"


def _reach(edges: str, nodes: str) -> str:
    """(node, component): the smallest node that each of nodes(node) reaches over edges(a, b), given both ways."""
    return f"""reach AS (SELECT node, node AS goal FROM {nodes} UNION SELECT r.node, e.b FROM reach r JOIN {edges} e ON e.a = r.goal),
  component AS (SELECT node, min(goal) AS component FROM reach GROUP BY node)"""


_CAPS = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
    WHERE {_VECTOR} AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
  edges AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
    WHERE list_cosine_similarity(p.x, q.x) >= 0.95),
  nodes AS (SELECT DISTINCT vec_id AS node FROM embeddings WHERE vec_id IS NOT NULL),
  {_reach("edges", "nodes")}
SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings JOIN component ON node = vec_id"""

_TOP_K = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE {_VECTOR}),
  scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


def _urls() -> str:
    rules = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in RULES)
    host = f"translate(regexp_extract(%s, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = "regexp_extract(%s, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    rest = "regexp_extract(%s, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    scheme = "regexp_extract(%s, '(?s)^(.*?)://', 1)"

    def address(url: str) -> str:
        return (
            f"CASE WHEN {host % url} <> '' THEN translate({scheme % url}, '{UPPER}', '{LOWER}') || '://' || {host % url}"
            f" || CASE {rest % url} WHEN '' THEN '/' ELSE {rest % url} END END"
        )

    def attribute(tag: str, name: str) -> str:
        form = r"""(?is)[\s"''/]%s\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))""" % name
        return "concat(" + ", ".join(f"regexp_extract({tag}, '{form}', {k})" for k in (1, 2, 3)) + ")"

    target = r"""regexp_extract(%s, '(?is)url\s*=\s*["'']?([^"'']*)', 1)""" % attribute("tag", "content")
    folder = "regexp_extract(url, '(?s)^.*?://[^/?#]*((?:/[^/?#]*)*/)', 1)"
    root = "regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)"
    full = f"""CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link LIKE '//%' THEN {scheme % "url"} || ':' || link
      WHEN link LIKE '/%' THEN {root} || link ELSE {root} || CASE {folder} WHEN '' THEN '/' ELSE {folder} END || link END"""
    return f"""WITH RECURSIVE p AS (SELECT row_number() OVER () AS k, page_id, coalesce({host % "url"}, '') AS host, coalesce({path % "url"}, '') AS path,
    {address("url")} AS address, url, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS html FROM pages),
  tags AS (SELECT address, url, unnest(regexp_extract_all(html, '(?i)<link\\b[^>]*>')) AS tag, true AS canonical FROM p
    UNION ALL SELECT address, url, unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*>')), false FROM p),
  links AS (SELECT address, url, replace(trim(CASE WHEN canonical THEN {attribute("tag", "href")} ELSE {target} END), '&amp;', '&') AS link FROM tags
    WHERE CASE WHEN canonical THEN regexp_matches({attribute("tag", "rel")}, '(?is)(^|\\s)canonical(\\s|$)')
      ELSE regexp_matches({attribute("tag", "http-equiv")}, '(?is)^\\s*refresh\\s*$') END),
  whole AS (SELECT address AS a, {full} AS target FROM links WHERE link <> '' AND address IS NOT NULL),
  one AS (SELECT a, {address("target")} AS b FROM whole WHERE target IS NOT NULL),
  edges AS MATERIALIZED (SELECT a, b FROM one WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM one WHERE b IS NOT NULL AND a <> b),
  nodes AS (SELECT DISTINCT a AS node FROM edges),
  {_reach("edges", "nodes")},
  rules AS (SELECT * FROM (VALUES {rules}) t(action, rule_host, rule_path)),
  judged AS (SELECT c.component, max(CASE action WHEN 'allow' THEN 2 ELSE 1 END) AS best FROM (
      SELECT node, action, row_number() OVER (PARTITION BY node ORDER BY len(rule_host || rule_path) DESC, len(rule_host) DESC) AS n
      FROM nodes JOIN rules ON ({host % "node"} = rule_host OR {host % "node"} LIKE '%.' || rule_host) AND starts_with({path % "node"}, rule_path)) r
    JOIN component c ON c.node = r.node WHERE n = 1 GROUP BY c.component),
  own AS (SELECT k, rule_host || rule_path AS rule, action FROM (
      SELECT k, rule_host, rule_path, action, row_number() OVER (PARTITION BY k ORDER BY len(rule_host || rule_path) DESC, len(rule_host) DESC) AS n
      FROM p JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)) WHERE n = 1)
SELECT page_id, host, path, rule, coalesce(action, CASE best WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN own USING (k) LEFT JOIN component c ON c.node = p.address LEFT JOIN judged USING (component)"""


def _licenses(coverage: float = 0.8, drift: int = 1) -> str:
    known = templates()
    rows = ", ".join(f"({i}, {at}, '{t.words[at]}', '{t.words[at + 1]}')" for i, t in enumerate(known) for at in range(len(t.words) - 1))
    facts = ", ".join(f"({i}, {len(t.words) - 1}, {str(t.base).lower()}, '{t.label}')" for i, t in enumerate(known))
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  pairs AS (SELECT k, i, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT k, w, unnest(range(len(w) - 1)) AS i FROM d)),
  hits AS (SELECT k, t, i, i - t_at AS diagonal FROM pairs JOIN (VALUES {rows}) x(t, t_at, ta, tb) ON a = ta AND b = tb),
  votes AS (SELECT k, t, diagonal, count(*) AS votes, min(i) AS low, max(i) AS high, any_value(pairs) AS pairs, any_value(base) AS base, any_value(label) AS label
    FROM hits JOIN (VALUES {facts}) f(t, pairs, base, label) USING (t) GROUP BY k, t, diagonal),
  marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= CASE WHEN base THEN 0 ELSE {drift} END THEN 0 ELSE 1 END AS apart
    FROM votes WINDOW o AS (PARTITION BY k, t ORDER BY diagonal)),
  spans AS (SELECT k, t, span, base, label, pairs, sum(votes) AS votes, min(low) AS low, max(high) AS high
    FROM (SELECT *, sum(apart) OVER (PARTITION BY k, t ORDER BY diagonal) AS span FROM marked) GROUP BY ALL),
  judged AS (SELECT *, base AND votes = pairs AS whole, least(1.0, CAST(votes AS DOUBLE) / pairs) AS part,
      NOT base AND CAST(votes AS DOUBLE) / pairs >= {coverage} AND high - low + 2 <= (pairs + 1) * 1.5 AS loose FROM spans),
  found AS (SELECT k, count(*) FILTER (WHERE whole) AS n_base, min(low) FILTER (WHERE whole) AS first_word, max(low) FILTER (WHERE whole) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole OR loose) AS labels,
      max(CASE WHEN whole THEN 1.0 WHEN loose THEN part END) AS score FROM judged GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found USING (k)"""


_JACCARD = rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS MATERIALIZED (SELECT DISTINCT k, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1 : i + 4], ' ') END AS s
    FROM (SELECT k, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
  sizes AS MATERIALIZED (SELECT k, count(*) AS n FROM sets GROUP BY k),
  shared AS (SELECT x.k AS a, y.k AS b, count(*) AS i FROM sets x JOIN sets y ON x.s = y.s AND x.k < y.k GROUP BY x.k, y.k),
  linked AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes p ON p.k = a JOIN sizes q ON q.k = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
  edges AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
  nodes AS (SELECT k AS node FROM d),
  {_reach("edges", "nodes")},
  least AS (SELECT component, min(doc_id) AS component_id FROM component JOIN d ON k = node GROUP BY component)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN component ON node = d.k JOIN least USING (component) LEFT JOIN sizes ON sizes.k = d.k"""

SQL: dict[str, str] = {
    "op2_spherical_caps": _CAPS,
    "op3_license_scan": _licenses(),
    "op5_url_filter": _urls(),
    "op6_m_tree_top_k": _TOP_K,
    "op9_ngram_jaccard": _JACCARD,
}
