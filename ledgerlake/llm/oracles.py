"""DuckDB SQL of the queries that SQL can express, over the same tables."""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _shingles(words: str) -> str:
    return (f"list_distinct(CASE WHEN len({words}) >= 5 THEN list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i+4], ' ')) "
            f"WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END)")


def ngram_join() -> str:
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, {_shingles('ws')} AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS h FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(a, b) AS (SELECT x, x FROM edge UNION SELECT r.a, l.y FROM reach r JOIN edge l ON r.b = l.x),
root AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(root.c, n.doc_id) AS component_id FROM n LEFT JOIN root ON root.a = n.doc_id"""


def decontaminate() -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM benchmark),
di AS (SELECT doc_id, unnest({_shingles('ws')}) AS h FROM d),
ii AS (SELECT item_id, unnest(g) AS h, len(g) AS n FROM (SELECT item_id, {_shingles('ws')} AS g FROM i)),
hit AS (SELECT doc_id, item_id, count(*) / min(n) AS share FROM di JOIN ii USING (h) GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * min(n)),
per AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(share) AS share FROM hit GROUP BY 1)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0) AS n_items, coalesce(items, '') AS items, coalesce(share, 0.0) AS share
FROM documents LEFT JOIN per USING (doc_id)"""


def url_filter(rules) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1] + r[2]))

    def case(out: int | None) -> str:
        return "CASE " + " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(v, h + p)[out]}'" for v, h, p in ordered) + " END"

    def parts(url: str) -> str:
        rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
        host = f"translate(regexp_extract({rest}, '^[^/?#]*'), {_LOWER})"
        return (f"coalesce({host}, '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path, "
                f"CASE WHEN {host} <> '' THEN {host} || regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) END AS node")

    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, {parts('url')} FROM pages),
tag AS (SELECT node AS a, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\\b[^>]{{1,900}}>')) AS t FROM p),
named AS (SELECT a, regexp_extract(t, '(?i)(?:href\\s*=\\s*["'']?|content\\s*=\\s*["'']?(?:[\\d.]+\\s*;\\s*url\\s*=\\s*["'']?)?)([a-z][a-z0-9+.-]*://[^\\s"''>]+)', 1) AS u FROM tag
  WHERE regexp_matches(t, '(?i)rel\\s*=\\s*["'']?canonical|property\\s*=\\s*["'']?og:url|http-equiv\\s*=\\s*["'']?refresh')),
target AS (SELECT a, {parts('u')} FROM named),
edge AS (SELECT a AS x, node AS y FROM target WHERE a IS NOT NULL AND node IS NOT NULL AND a <> node
  UNION SELECT node, a FROM target WHERE a IS NOT NULL AND node IS NOT NULL AND a <> node),
reach(a, b) AS (SELECT x, x FROM edge UNION SELECT r.a, e.y FROM reach r JOIN edge e ON r.b = e.x),
other AS (SELECT a, {parts("'x://' || b").replace(' AS node', ' AS n2')} FROM reach),
hit AS (SELECT DISTINCT a FROM other WHERE {case(0)} = 'block')
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN hit.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hit ON hit.a = p.node"""


def crc32(octets: str) -> str:
    """The unsigned CRC-32 of a list of bytes (bigint), as an expression over ``crc_table.step``."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            "lambda a, b: xor(a >> 8, step[xor(a & 255, b) + 1])), 4294967295)")


#: One row with the CRC-32 of each single byte, made from the polynomial.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS step FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(i)))"""


def prefix_trie() -> str:
    h = crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)") + " % 6"
    return f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS size,
        left(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id
      FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, id, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {h} AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
turns AS (SELECT c.conv_id, 0 AS part, i, id, size FROM c JOIN own ON own.conv_id = c.base AND i < h
          UNION ALL SELECT c.conv_id, 1, i, id, size FROM c JOIN own ON own.conv_id = c.conv_id AND i >= h),
paths AS (SELECT conv_id, size, row_number() OVER w AS d, string_agg(id, '') OVER w AS path FROM turns
          WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
total AS (SELECT c.conv_id, coalesce(max(d), 0) AS d FROM c LEFT JOIN paths USING (conv_id) GROUP BY 1),
every AS (SELECT conv_id, size, d, path FROM paths UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT path, every.d AS d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total.d = every.d), '')) AS ends_sha256
          FROM every JOIN total USING (conv_id) GROUP BY path, every.d),
kids AS (SELECT left(path, 32 * (d - 1)::INT) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sums AS (SELECT left(path, (32 * k)::INT) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n - 1) * size) AS saved_tokens
         FROM (SELECT *, unnest(range(d::BIGINT + 1)) AS k FROM full_nodes) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s USING (path) LEFT JOIN full_nodes p ON f.d > 0 AND p.path = left(f.path, (32 * (f.d - 1))::INT)
"""


def spelling() -> str:
    octets = "list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(encode(s)), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), {_LOWER}) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM runs WHERE length(w) >= 5 GROUP BY 1, 2),
hashed AS (SELECT w, n, {crc32(octets)} AS h FROM each, crc_table),
noisy AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w) + 2)::INT) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM noisy WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, left(word, i::INT) AS a, substr(word, (i + 2)::INT) AS b FROM (SELECT *, unnest(range(length(word)::BIGINT)) AS i FROM v)),
pair AS (SELECT x.word, x.n, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
         UNION SELECT x.word, x.n, v.word, v.n FROM cut x JOIN v ON v.word = x.a || x.b
         UNION SELECT v.word, v.n, x.word, x.n FROM cut x JOIN v ON v.word = x.a || x.b),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS m FROM pair GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN best END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
      FROM v LEFT JOIN near USING (word)),
up(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.form)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.form IS NULL
"""
