"""DuckDB SQL of the operators whose whole result SQL can express; each compares all pairs or follows all rules anew."""

from __future__ import annotations

#: ASCII white space parts words; A-Z are lower-cased, other letters stay.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _components(vertices: str, links: str) -> str:
    """CTEs comp(id, c): the least id within reach over `links` (a, b), both ways."""
    return f"""reach(id, c) AS (SELECT id, id FROM {vertices} UNION SELECT l.b, r.c FROM reach r JOIN {links} l ON l.a = r.id WHERE r.c < l.b),
      comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)"""


#: Copies of one set are represented by the least id; pairs are met by shared shingles and decided on whole sets.
OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
  u AS (SELECT doc_id, len(ws) AS k, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
  five AS (SELECT doc_id, k, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS v FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  sh AS (SELECT DISTINCT doc_id, v FROM five WHERE i <= greatest(1, k - 4)),
  s AS (SELECT doc_id, count(*) AS n, md5(string_agg(v, '|' ORDER BY v)) AS same FROM sh GROUP BY doc_id),
  n AS (SELECT same, min(doc_id) AS id, any_value(n) AS n FROM s GROUP BY same),
  e AS (SELECT n.id, n.n, sh.v FROM n JOIN sh ON sh.doc_id = n.id),
  p AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.v = y.v AND x.id < y.id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
    GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
  linked AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  {_components("n", "linked")}
  SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, d.doc_id = coalesce(comp.c, d.doc_id) AS kept
  FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN n ON n.same = s.same LEFT JOIN comp ON comp.id = n.id"""

OP6 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
  linked AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95),
  {_components("v", "linked")}, k AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
  SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, vec_id) AS component_id, vec_id = coalesce(comp.c, vec_id) AS kept
  FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN comp ON comp.id = vec_id"""


def _crc32(text: str) -> str:
    """Every byte is taken in, then eight bits are shifted out."""
    step = "lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)"
    codes = f"flatten(list_transform(range(1, CAST(len({text}) AS BIGINT) + 1), lambda i: [CAST(ord({text}[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), {step}), 4294967295)"


def _level(name: str, k: int, path: list[str], parent: str | None) -> str:
    """Budgets of a level: the siblings that meet their capacity at a common rate come first, the others share what is left."""
    cols, up = ", ".join(path[: k + 1]), ", ".join(path[:k])
    of = f"PARTITION BY {up}" if k else ""
    w = " AND ".join(f"t.{c} = n.{c}" if i <= k else f"t.{c} IS NULL" for i, c in enumerate(path))
    src = f"JOIN {parent} USING ({up})" if parent != "top" else "CROSS JOIN top"
    keep = ", ".join(f"n.{c}" for c in path[: k + 1])
    return f"""{name}a AS (SELECT {keep}, n.cap, coalesce(t.w, 1)::HUGEINT AS w FROM (SELECT {cols}, sum(cap)::HUGEINT AS cap FROM leaves GROUP BY {cols}) n LEFT JOIN weights t ON {w}),
  {name}b AS (SELECT n.*, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rw
    FROM {name}a n {src} WINDOW o AS ({of} ORDER BY cap::DOUBLE / w, {path[k]})),
  {name} AS (SELECT {cols}, CASE WHEN cap * rw <= w * rb THEN cap ELSE (w * max(rb) FILTER (cap * rw > w * rb) OVER ({of})) // (max(rw) FILTER (cap * rw > w * rb) OVER ({of})) END::HUGEINT AS budget FROM {name}b)"""


def op5(weights: list[tuple], share: float, epochs: int, seed: str) -> str:
    """Every key of a leaf's epoch in order, up to the last whose sum still fits."""
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows, path = ", ".join("(" + ", ".join(map(text, w)) + ")" for w in weights), ["domain", "language", "source"]
    return f"""WITH weights(domain, language, source, w) AS (VALUES {rows}),
  d AS (SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
  doms AS (SELECT source, 'd' || CAST({_crc32("source")} % 3 AS VARCHAR) AS domain FROM (SELECT DISTINCT source FROM d)),
  r AS (SELECT d.*, domain FROM d JOIN doms USING (source)),
  leaves AS (SELECT domain, language, source, sum(tokens)::HUGEINT AS tokens, {epochs} * sum(tokens)::HUGEINT AS cap FROM r GROUP BY domain, language, source),
  top AS (SELECT least(sum(cap), floor(CAST('{share}' AS DECIMAL(10, 6)) * sum(tokens)))::HUGEINT AS budget FROM leaves),
  {_level("l0", 0, path, "top")}, {_level("l1", 1, path, "l0")}, {_level("l2", 2, path, "l1")},
  plan AS (SELECT domain, language, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epoch, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
    FROM leaves JOIN l2 USING (domain, language, source)),
  k AS (SELECT r.*, epoch, rest, md5('{seed}|' || epoch || '|' || id) AS key FROM r JOIN plan USING (domain, language, source)),
  c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
  SELECT doc_id, domain, language, source, CAST(tokens AS BIGINT) AS tokens, CAST(epoch + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM c"""


# The parts of op3, op8 and op10 that SQL can say; tests hold the operators' columns of these names against them.

_NAMED = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(pattern: str, least: int, group: int = 0) -> str:
    return f"CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}', {group}), lambda x: len(x) >= {least})) AS BIGINT)"


OP3_BASE = f"SELECT doc_id, {_found(_NAMED, 12, 1)} AS n_assign, {_found('AKIA[A-Z0-9]+', 18)} AS n_access, {_found('[0-9a-f]+', 16)} AS n_hex FROM documents"

OP8_BASE = f"""WITH h AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_WORDS} AS ws FROM documents),
  d AS (SELECT doc_id, {_crc32("id")} % 5 = 1 AS held_out, list_append(ws, '') AS ws FROM h),
  t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
  c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), s AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
  SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(s.n) AS BIGINT) AS train_tokens,
    round(sum(log10((coalesce(c.c, 0) + 0.5) / (s.n + 0.5 * (s.v + 1)))), 4) AS base_score
  FROM t LEFT JOIN c USING (w) CROSS JOIN s GROUP BY doc_id, held_out"""


def op10_base(rules: list) -> str:
    """host, path and rule; rules: those of urls.judge."""
    rows = ", ".join(f"({i}, '{r.host}', '{r.path}', '{r.text}')" for i, r in enumerate(rules))
    return f"""WITH r(i, h, p, rule) AS (VALUES {rows}), u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
      q AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
      SELECT page_id, host, path, arg_max(rule, len(rule) * 1000 - i) AS rule FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path"""
