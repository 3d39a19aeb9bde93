"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations


def url_filter(rules: list[tuple[str, str, str]], order: int, held_out: int) -> str:
    """Rules by a values list; one WITH step per context length."""
    values = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}', {len(h + p)})" for v, h, p in rules)
    levels = []
    for k in range(1, order + 2):
        shorter = ", 1/256::double AS qa, 1/256::double AS qb FROM l" if k == 1 else f", s.pa AS qa, s.pb AS qb FROM l JOIN m{k - 1} s ON s.gram = right(l.gram, {k - 1})"
        levels.append(f"""
m{k} AS (
  WITH l AS (SELECT right(gram, {k}) AS gram, left(right(gram, {k}), {k - 1}) AS ctx, sum(a)::double AS a, sum(b)::double AS b FROM counts GROUP BY ALL),
  n AS (SELECT ctx, sum(a) AS na, count(*) FILTER (a > 0) AS ta, sum(b) AS nb, count(*) FILTER (b > 0) AS tb FROM l GROUP BY ctx),
  q AS (SELECT l.*{shorter})
  SELECT gram, CASE WHEN na > 0 THEN (a + ta * qa) / (na + ta) ELSE qa END AS pa, CASE WHEN nb > 0 THEN (b + tb * qb) / (nb + tb) ELSE qb END AS pb
  FROM q JOIN n USING (ctx))""")
    pad = f"repeat(chr(1), {order})"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r(verdict, h, pre, rule, size) AS (VALUES {values}),
d AS (SELECT DISTINCT url, CASE WHEN contains(url, '://') THEN split_part(substr(url, strpos(url, '://') + 3), '/', 1) ELSE '' END AS rough FROM p),
parts AS (
  SELECT url, translate(regexp_extract(rough, '^[^?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3 + length(regexp_extract(rough, '^[^?#]*'))), '^[^?#]*') ELSE '' END AS path FROM d),
ruled AS (
  SELECT url, host, path, arg_max(rule, size) AS rule, arg_max(verdict, size) AS ruled
  FROM parts LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, pre) GROUP BY ALL),
urls AS (
  SELECT u.*, n, ('0x' || left(md5(url), 8))::bigint % {held_out} = 0 AS held
  FROM ruled u JOIN (SELECT url, count(*) AS n FROM p GROUP BY url) USING (url)),
places AS (SELECT url, n, ruled, held, substr({pad} || url || chr(2), i::bigint, {order + 1}) AS gram FROM urls, LATERAL (SELECT unnest(range(1, length(url) + 2)) AS i)),
counts AS (
  SELECT gram, sum(CASE WHEN ruled = 'allow' AND NOT held THEN n ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' AND NOT held THEN n ELSE 0 END) AS b
  FROM places GROUP BY gram),{",".join(levels)},
scored AS (SELECT url, round(avg(ln(pa) - ln(pb)), 9) AS score FROM places JOIN m{order + 1} USING (gram) GROUP BY url),
bins AS (
  SELECT floor(score * 100)::bigint AS bin, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS b
  FROM urls JOIN scored USING (url) WHERE held AND ruled IS NOT NULL GROUP BY 1),
gains AS (
  SELECT bin, coalesce(sum(b) OVER w, 0) / nullif(sum(b) OVER (), 0) - coalesce(sum(a) OVER w, 0) / nullif(sum(a) OVER (), 0) AS gain
  FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT bin / 100 FROM gains WHERE gain IS NOT NULL ORDER BY gain DESC, bin LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, score
FROM p JOIN urls USING (url) JOIN scored USING (url), cut
"""


def merkle() -> str:
    clause = "regexp_extract_all(x, '[^.,;:!?|]{{0,32}}[.,;:!?|]|[^.,;:!?|]{{1,32}}')"
    leaves = f"list_transform(string_split({{0}}, chr(10)), lambda x: list_transform({clause}, lambda c: md5(c)))"
    lines = "list_transform({0}, lambda x: sha256(coalesce(array_to_string(x, ''), '')))"
    hashed = "list_transform(flatten({0}), lambda c: left(c, 8))"
    cut = "string_split(regexp_replace(array_to_string({0}, ' '), '([0-3][0-9a-f]{{63}}) ', '\\1|', 'g'), '|')"
    root = f"sha256(array_to_string(list_transform({cut}, lambda s: sha256(s)), ' '))"
    first = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
    near = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"
    changed = f"string_split(array_to_string(list_filter({cut.format('tp')}, lambda s: NOT list_contains({cut.format('ep')}, s)), ' '), ' ')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM d),
e AS (SELECT *, length(text) AS n, left(text, length(text) - length(text) // 4) || left(nxt, length(text) // 4) AS edited FROM o),
l AS (SELECT *, {leaves.format("text")} AS tl, {leaves.format("edited")} AS el, {leaves.format("nxt")} AS nl FROM e),
h AS (SELECT *, {lines.format("tl")} AS tp, {lines.format("el")} AS ep, {hashed.format("tl")} AS t0, {hashed.format("el")} AS e0, {hashed.format("nl")} AS n0 FROM l),
f AS (SELECT *, {first.format("t0")} AS tc, {first.format("e0")} AS ec, {first.format("n0")} AS nc, {changed} AS changed FROM h)
SELECT doc_id, n::bigint AS n_chars, sha256(edited) AS edited_sha256,
  {root.format("tp")} || ':' || coalesce(array_to_string(tc, ''), '') AS fingerprint, {root.format("ep")} || ':' || coalesce(array_to_string(ec, ''), '') AS edited_fingerprint,
  {near.format("tc", "ec")} AS near_edited, {near.format("tc", "nc")} AS near_next,
  coalesce(array_to_string(list_filter(range(len(tp)), lambda i: list_contains(changed, tp[i + 1]) AND NOT list_contains(ep, tp[i + 1])), ','), '') AS edited_paragraphs
FROM f
"""


ARCHIVE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, size::bigint AS payload_bytes, digest AS payload_digest,
  CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, unnest(vec) AS value, unnest(range(len(vec))) AS at FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.value * c.value)::bigint AS score FROM x q JOIN x c ON q.at = c.at AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 10
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i AS pos, substr(h, (2 * i + 1)::bigint, 100) AS w FROM d, LATERAL (SELECT unnest(range(n - 49)) AS i)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY w) AS least FROM w) WHERE doc_id > least),
starts AS (SELECT *, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, true) AS is_new FROM r),
runs AS (SELECT doc_id, run_no, min(pos) AS s, max(pos) + 50 AS e FROM (SELECT *, sum(is_new::int) OVER (PARTITION BY doc_id ORDER BY pos) AS run_no FROM starts) GROUP BY ALL),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prior FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * prior + 1)::bigint, (2 * (s - prior))::bigint), '' ORDER BY s) AS front, max(e) AS stop, sum(e - s) AS removed, count(*) AS spans FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::bigint AS n_bytes, coalesce(removed, 0)::bigint AS n_removed, coalesce(spans, 0)::bigint AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, (2 * coalesce(stop, 0) + 1)::bigint))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, label, unnest(vec) AS value, unnest(range(len(vec))) AS at FROM v),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, sum(q.value * c.value)::bigint AS score
  FROM x q JOIN x c ON q.at = c.at AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

LINES = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS goes FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN NOT goes THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
