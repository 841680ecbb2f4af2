"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
k AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS key FROM s),
r AS (SELECT key FROM k GROUP BY key HAVING count(*) > 1),
c AS (SELECT DISTINCT k.doc_id, k.i + j.j AS p FROM k JOIN r USING (key), (SELECT unnest(range(35)) AS j) j),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

SQL["op7_balltree"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _rank(name: str, edges: str, seeds: str, rounds: int = 10) -> str:
    """Unrolled rounds of personalised PageRank in whole numbers."""
    parts = [
        f"{name}_out AS (SELECT src, sum(w) AS out FROM {edges} GROUP BY src)",
        f"{name}_seed AS (SELECT host, (1000000000000000 // (SELECT greatest(1, sum(n)) FROM {seeds})) * n AS seed FROM {seeds})",
        f"{name}_0 AS (SELECT host, seed::HUGEINT AS rank FROM {name}_seed)",
    ]
    for k in range(rounds):
        parts.append(
            f"{name}_{k + 1} AS (SELECT host, sum(rank) AS rank FROM (SELECT e.dst AS host, (rank * 85 // 100 // o.out) * e.w AS rank FROM {edges} e JOIN {name}_out o ON e.src = o.src JOIN {name}_{k} r ON e.src = r.host"
            f" UNION ALL SELECT host, seed * 15 // 100 FROM {name}_seed) GROUP BY host)"
        )
    return ",\n".join(parts)


SQL["op6_url_graph"] = (
    r"""
WITH u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM u),
v AS (SELECT *, CASE rule WHEN 'example.com/en/7' THEN 'allow' WHEN 'net/de/' THEN 'allow' WHEN 'com/en/' THEN 'block' WHEN 'example.net/de/8' THEN 'block' WHEN 'org/es/' THEN 'block' END AS ruled FROM j),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]*)', 1)) AS to_host FROM u),
e AS (SELECT src, translate(to_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, count(*) AS w FROM l GROUP BY 1, 2 HAVING src <> '' AND dst <> '' AND src <> dst),
b AS (SELECT dst AS src, src AS dst, w FROM e),
good AS (SELECT host, count(*) AS n FROM v WHERE host <> '' AND ruled = 'allow' GROUP BY host),
bad AS (SELECT host, count(*) AS n FROM v WHERE host <> '' AND ruled = 'block' GROUP BY host),
"""
    + _rank("t", "e", "good")
    + ",\n"
    + _rank("d", "b", "bad")
    + """
SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d_10.rank, 0) > coalesce(t_10.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(t_10.rank, 0)::BIGINT AS trust, coalesce(d_10.rank, 0)::BIGINT AS distrust
FROM v LEFT JOIN t_10 ON v.host = t_10.host LEFT JOIN d_10 ON v.host = d_10.host
"""
)


def _crc32(x: str) -> str:
    """The unsigned crc32 of a number's decimal digits."""
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(({x})::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {bits}), 4294967295::BIGINT)"


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || {x} END"


def _tree(name: str, leaves: str) -> str:
    """Nodes and runs over leaves (tree, idx, digest), level by level."""
    return f"""{name}_nodes AS (SELECT tree, 0 AS level, idx, digest, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 2) // 3) FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, idx // 3),
{name}_runs AS (SELECT tree, level, idx // 3 AS run, list(digest ORDER BY idx) AS d FROM {name}_nodes WHERE n > 1 GROUP BY ALL)"""


def _climb(name: str, start: str) -> str:
    """Proofs and folded digests from rows (row, tree, idx, proof, h) up to the tree's root."""
    return f"""{name}_up AS (SELECT row, tree, 0 AS level, idx, proof, h FROM {start}
  UNION ALL SELECT u.row, u.tree, u.level + 1, r.run, proof || array_to_string(d[1:u.idx % 3], '') || array_to_string(d[u.idx % 3 + 2:], ''), sha256(array_to_string(d[1:u.idx % 3], '') || h || array_to_string(d[u.idx % 3 + 2:], ''))
  FROM {name}_up u JOIN {name}_runs r ON u.tree = r.tree AND u.level = r.level AND u.idx // 3 = r.run)"""


SQL["op12_merkle"] = f"""
WITH RECURSIVE f AS (SELECT doc_id, source, coalesce('1' || source, '0') AS tree, text, {_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} AS head,
  doc_id IS NOT NULL AND {_crc32("coalesce(doc_id, 0)")} % 2 = 0 AS tampered FROM documents),
x AS (SELECT doc_id, tree, sha256(head || {_field("text")}) AS digest, sha256(head || CASE WHEN tampered THEN {_field("replace(text, chr(10), '')")} ELSE {_field("text")} END) AS h FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, row_number() OVER () AS row FROM x),
{_tree("s", "l")},
t AS (SELECT 't' AS tree, tree AS source, digest, row_number() OVER (ORDER BY tree) - 1 AS idx FROM s_nodes WHERE n = 1),
{_tree("t", "t")},
b AS (SELECT row, tree, idx, '' AS proof, h FROM l),
{_climb("s", "b")},
m AS (SELECT u.row, 't' AS tree, t.idx, u.proof, u.h FROM s_up u JOIN s_nodes n ON u.tree = n.tree AND u.level = n.level AND n.n = 1 JOIN t ON u.tree = t.source),
{_climb("t", "m")}
SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, r.digest AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = r.digest AS verified, l.h <> l.digest AS tampered,
  CASE WHEN l.tree <> '0' THEN l.tree[2:] END AS source, l.idx AS leaf_index
FROM t_up u JOIN t_nodes r ON u.level = r.level AND r.n = 1 JOIN l ON l.row = u.row JOIN t ON l.tree = t.source
"""

SQL["op13_prefix_trie"] = f"""
WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS first, {_crc32("conv_id")} % 4 AS h FROM o),
r AS (SELECT c.conv_id, 0 AS part, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.first AND o.i < c.h UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i >= c.h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, role, text, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r),
p AS (SELECT c.conv_id, 0::BIGINT AS d, '' AS id, '' AS parent, 0::BIGINT AS words FROM c
  UNION ALL SELECT t.conv_id, t.d, sha256(p.id || ':' || strlen(t.role) || ':' || t.role || t.text), p.id, t.words::BIGINT FROM p JOIN t ON t.conv_id = p.conv_id AND t.d = p.d + 1),
e AS (SELECT *, lead(d) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS ends FROM p),
n AS (SELECT d, id, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended FROM e GROUP BY d, id),
k AS (SELECT d - 1 AS d, parent AS id, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, id)),
s AS (SELECT d, id, d AS up, id AS top, (n_convs - 1) * words AS saved, (n_children = 0)::BIGINT AS leaf FROM w
  UNION ALL SELECT s.d, s.id, w.d - 1, w.parent, s.saved, s.leaf FROM s JOIN w ON w.d = s.up AND w.id = s.top WHERE s.up > 0),
u AS (SELECT up AS d, top AS id, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM s GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens, sha256(w.ended) AS ends_sha256
FROM w JOIN u USING (d, id) LEFT JOIN w q ON q.d = w.d - 1 AND q.id = w.parent
"""
