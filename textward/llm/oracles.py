"""DuckDB SQL for the queries that it can express at the size of the comparison."""

from __future__ import annotations

from textward.llm import decontaminate, quality, sharding

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _draw(key: str, node: sharding.Node) -> str:
    return f"(-ln((CAST('0x' || substr(md5({key} || ':{node.label}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE) / {node.mass!r}::DOUBLE)"


def _descend(key: str, node: sharding.Node) -> str:
    """The child of the least draw, and so on down to a shard."""
    if node.shard is not None:
        return str(node.shard)
    draws = [_draw(key, c) for c in node.children]
    least = f"least({', '.join(draws)})"
    return "CASE " + " ".join(f"WHEN {d} = {least} THEN {_descend(key, c)}" for d, c in zip(draws, node.children, strict=True)) + " END"


def _sharding(shards: int = 24) -> str:
    tree = sharding.even_tree(shards)
    new = sharding.grown(tree, shards).children[-1]
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "SELECT i, i AS c FROM range(256) r(i)"
    for _ in range(8):
        table = f"SELECT i, {step} AS c FROM ({table})"
    key = "CAST(doc_id AS VARCHAR)"
    old = ", ".join(_draw(key, c) for c in tree.children)
    return f"""WITH crc AS (SELECT list(c ORDER BY i) AS t FROM ({table})),
b AS (SELECT doc_id, octet_length(encode(text)) + 8 AS size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, size, CASE WHEN len(bytes) = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, t[xor(a, x) & 255 + 1])), 4294967295) END AS text_crc32 FROM b, crc),
s AS (SELECT *, {_descend(key, tree)} AS shard, CASE WHEN {_draw(key, new)} < least({old}) THEN {shards} END AS moved,
CAST('0x' || substr(md5(concat_ws('|', doc_id, text_crc32, size)), 1, 4) AS INT) % {sharding.SLOT_PARTS} AS part FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1 AS slot, CAST(coalesce(moved, shard) AS INT) AS grown_shard FROM s""".replace("& 255 + 1", "& 255) + 1").replace("t[xor(a, x)", "t[(xor(a, x)")


def _decontamination(window: int = decontaminate.WINDOW) -> str:
    words = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
iw AS (SELECT item_id, q, least({window}, len(w)) AS m, array_to_string(w[q + 1 : q + least({window}, len(w))], ' ') AS k FROM (SELECT *, unnest(range(len(w) - least({window}, len(w)) + 1)) AS q FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {words} AS w FROM documents),
dw AS (SELECT doc_id, m, p, array_to_string(w[p + 1 : p + m], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hits AS (SELECT doc_id, item_id, m, p, q FROM dw JOIN iw USING (m, k)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, m, p - q ORDER BY p) AS island FROM hits),
grown AS (SELECT doc_id, item_id, p, q, m + max(p) OVER (PARTITION BY doc_id, item_id, m, p - q, island) - p AS n FROM runs),
best AS (SELECT * FROM grown QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id, p, q) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
CAST(coalesce(best.n, 0) AS BIGINT) AS longest_words, best.item_id AS longest_item, CAST(coalesce(best.p, -1) AS BIGINT) AS longest_at, CAST(coalesce(best.q, -1) AS BIGINT) AS longest_item_at
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)"""


def _near(percent: int = 85, k: int = 5) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + {k}], ' ') AS g FROM (SELECT *, unnest(range(greatest(1, len(w) - {k - 1}))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
e AS (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def _quality() -> str:
    q = quality
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
g AS (SELECT doc_id, p, hash(w[p], w[p + 1], w[p + 2]) AS k FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM t WHERE len(w) >= 3)),
twice AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS pos FROM twice) GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS lines, length(regexp_replace(text, '[^!]', '', 'g')) AS bangs FROM t LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > {q.MAX_SYMBOL_PERCENT} * n_words OR 100 * bangs > {q.MAX_BANG_PERCENT} * n_words
OR 100 * n_dup_lines > {q.MAX_DUP_LINE_PERCENT} * lines OR word_chars < {q.MEAN_WORD[0]} * n_words OR word_chars > {q.MEAN_WORD[1]} * n_words) AS kept FROM b"""


SQL: dict[str, str] = {"op1_sharding": _sharding(), "op3_decontamination": _decontamination(), "op5_near_dedup": _near(), "op9_quality_rules": _quality()}
