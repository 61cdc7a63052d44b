"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from millrace.llm.queries import URL_RULES
from millrace.llm.sharding import Leaf, topology

_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"

OP1 = rf"""
WITH sized AS (
  SELECT doc_id, source, {_SIZE} AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM sources
), remaining AS (
  SELECT *,
         1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER earlier, 0) AS budget_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weight_left
  FROM weighed
  WINDOW earlier AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, cap * weight_left <= weight * budget_left AS is_capped FROM remaining
), targets AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN cap
              ELSE max(budget_left) FILTER (NOT is_capped) OVER () / max(weight_left) FILTER (NOT is_capped) OVER () * weight
         END AS target
  FROM capped
), placed AS (
  SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS wanted,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS epochs FROM placed
)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, wanted - epochs * source_size - before)))::BIGINT AS taken
FROM cut
"""


def _draw(level: str, node: int, weight: float) -> str:
    unit = f"((('0x' || substr(md5(key || '/{level}/{node}'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"
    return f"{{'draw': -ln({unit}) / {float(weight)}::DOUBLE, 'node': {node}}}"


def _choose(level: str, weights: dict[int, float]) -> str:
    if len(weights) == 1:
        return str(next(iter(weights)))
    return f"list_min([{', '.join(_draw(level, n, w) for n, w in sorted(weights.items()))}]).node"


def _place(tree: list[Leaf]) -> str:
    def total(rows: list[Leaf], level: int) -> dict[int, float]:
        out: dict[int, float] = {}
        for r in rows:
            out[r[level]] = out.get(r[level], 0.0) + r[3]
        return out

    def descend(rows: list[Leaf], level: int, at: tuple[int, ...]) -> str:
        weights = total(rows, level)
        name = "/".join(map(str, (("region", "rack", "shard")[level], *at)))
        if level == 2:
            return _choose(name, weights)
        below = {n: descend([r for r in rows if r[level] == n], level + 1, (*at, n)) for n in sorted(weights)}
        if len(below) == 1:
            return next(iter(below.values()))
        return f"CASE {_choose(name, weights)} {' '.join(f'WHEN {n} THEN {x}' for n, x in below.items())} END"

    return descend(tree, 0, ())


#: DuckDB has no crc32, so its table comes from the rule of the reflected polynomial.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256))::BIGINT AS i)
)"""


def _crc32(digits: str) -> str:
    """The checksum of bytes given as hex digits, beside ``crc_table``."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({digits}), 2),
           lambda p: ('0x' || substr({digits}, p, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"""


OP2 = f"""
WITH {_CRC_TABLE}, keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS key FROM documents
), hexed AS (
  SELECT *, hex(encode(text)) AS digits FROM keyed
), placed AS (
  SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS size,
         {_crc32("digits")} AS text_crc32,
         ({_place(topology(8))})::INT AS shard, ({_place(topology(9))})::INT AS grown_shard, md5(key) AS h
  FROM hexed, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY h, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM placed
"""

OP7 = r"""
WITH docs AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM docs
), cut AS (
  SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = 1 OR
    ((CASE WHEN i > 2 THEN h[i - 2] ELSE 0 END) * 31 + h[i - 1]) % 65537 % 2 = 0) AS starts
  FROM hashed
), pieces AS (
  SELECT doc_id, unnest(range(1, len(starts) + 1)) AS place, starts, lines FROM cut
), chunks AS (
  SELECT doc_id, place, lines[starts[place]:coalesce(starts[place + 1], len(lines) + 1) - 1] AS part FROM pieces
), judged AS (
  SELECT *, array_to_string(part, chr(10)) AS chunk,
         len(part) >= 2 AND regexp_matches(array_to_string(part, chr(10)), '[^\x20\x09-\x0D]') AS counts
  FROM chunks
), numbered AS (
  SELECT *, counts AND row_number() OVER (PARTITION BY chunk, counts ORDER BY doc_id NULLS FIRST, place) > 1 AS gone FROM judged
), joined AS (
  SELECT doc_id, sum(len(part)) FILTER (gone) AS lines_removed,
         coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
  FROM numbered GROUP BY doc_id
)
SELECT d.doc_id, coalesce(j.lines_removed, 0)::BIGINT AS lines_removed, md5(coalesce(j.text, d.text)) AS text_md5
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""

OP8 = """
WITH q AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP10 = f"""
WITH split AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(h, p, v) AS (VALUES {_RULES}), fits AS (
  SELECT s.*, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY len(h || p) DESC NULLS LAST, h || p) AS n
  FROM split s LEFT JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE n = 1
"""



def _merkle(name: str, levels: int) -> str:
    """CTEs {name}0 (g, place, n, h) up to {name}{levels}, and {name}_way (g, place, lvl, before, after) of each node."""
    up = [
        f"""{name}{k + 1} AS (
  SELECT g, place // 16 AS place, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY place)) AS h FROM {name}{k} WHERE n > 1 GROUP BY g, place // 16, n
)"""
        for k in range(levels)
    ]
    way = " UNION ALL ".join(
        f"""SELECT g, place, {k} AS lvl, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY g, place // 16 ORDER BY place)"""
        for k in range(levels)
    )
    top = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ", ".join(up) + f", {name}_way AS ({way}), {name}_top AS ({top})"


def _told(columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns.split(", ")) + ")"


_LEVELS = 6  # sources of up to 16 ** 6 documents
OP13 = f"""
WITH {_CRC_TABLE}, rows AS (
  SELECT *, {_told("doc_id, source, lang, n_chars, text")} AS leaf,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded, hex(encode(doc_id::VARCHAR)) AS digits
  FROM documents
), leaves AS (
  SELECT doc_id, source AS g, leaf, {_told("doc_id, source, lang, n_chars, folded")} AS other,
         coalesce({_crc32("digits")} % 5 = 0, false) AS tampered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM rows, crc_table
), named AS (
  SELECT * REPLACE (coalesce('s' || g, 'n') AS g) FROM leaves
), d0 AS (
  SELECT g, place, n, leaf AS h FROM named
), {_merkle("d", _LEVELS)}, s0 AS (
  SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n, h, g AS source FROM d_top
), {_merkle("s", 3)}, siblings AS (
  SELECT l.doc_id, l.g, l.place, w.lvl, w.before, w.after FROM named l JOIN d_way w ON w.g = l.g AND w.place = l.place // (16 ** w.lvl)::BIGINT
  UNION ALL
  SELECT l.doc_id, l.g, l.place, 100 + w.lvl, w.before, w.after
  FROM named l JOIN s0 s ON s.source = l.g JOIN s_way w ON w.place = s.place // (16 ** w.lvl)::BIGINT
), ways AS (
  SELECT g, place, list({{'before': before, 'after': after}} ORDER BY lvl) AS way FROM siblings GROUP BY g, place
), folded AS (
  SELECT l.*, t.h AS subroot, r.h AS root, coalesce(w.way, []) AS way,
         list_reduce(list_prepend({{'before': CASE WHEN tampered THEN other ELSE leaf END, 'after': ''}}, coalesce(w.way, [])),
                     lambda node, s: {{'before': sha256(s.before || node.before || s.after), 'after': ''}}).before AS folded_root
  FROM named l JOIN d_top t ON t.g = l.g CROSS JOIN s_top r LEFT JOIN ways w ON w.g = l.g AND w.place = l.place
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(way, lambda s: s.before || s.after), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

OP11 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), least AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m ON m.vec_id = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE}, found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc,
         unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+'),
                               lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run
  FROM documents
), counted AS (
  SELECT doc, run, count(*) AS times, hex(encode(doc || ':' || run)) AS digits FROM found WHERE length(run) >= 7 GROUP BY doc, run
), summed AS (
  SELECT run, times, {_crc32("digits")} AS h FROM counted, crc_table
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 7 AND sum(times) >= 2
), shorter AS (
  SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN shorter b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, min({{'less': -n, 'near': near}}) AS best FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 10 * w.n THEN best.near END AS form,
         CASE WHEN -best.less >= 10 * w.n THEN (-best.less)::BIGINT END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word
), ways AS (
  SELECT word, coalesce(form, word) AS root FROM forms
  UNION SELECT ways.word, f.form FROM ways JOIN forms f ON f.word = ways.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT w.word, w.root FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""

ORACLES = {"op1_mix": OP1, "op2_shard": OP2, "op7_lines": OP7, "op8_topk": OP8, "op10_urls": OP10, "op11_vectors": OP11, "op12_spelling": OP12, "op13_merkle": OP13}
