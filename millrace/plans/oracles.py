"""DuckDB SQL for the results of queries.py."""

from __future__ import annotations

from millrace.functions.text import HTML_STEPS, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_CORPUS = """corpus AS (
  SELECT doc_id, text, lang, n_chars, source AS kb_id,
         CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END AS visibility,
         doc_id % 4 AS role, doc_id % 7 AS owner
  FROM documents
)"""


def _bm25(name: str, docs: str, stop: bool) -> str:
    where = f"WHERE term NOT IN ({_STOP})" if stop else ""
    return f"""{name}_words AS (SELECT doc_id, {_TOKENS} AS words FROM {docs}),
{name}_stats AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM {name}_words),
{name}_terms AS (SELECT query_id, term FROM (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) {where}),
{name}_tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM {name}_words) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
    / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score
  FROM {name}_tf JOIN {name}_df USING (term) CROSS JOIN {name}_stats JOIN {name}_terms USING (term) GROUP BY query_id, doc_id)"""


def _bow(name: str, docs: str) -> str:
    def side(of: str, key: str, table: str) -> str:
        return f"""{of}c AS (SELECT {key}, ('0x' || right(md5(t), 3))::INT AS dim, count(*)::DOUBLE AS c
  FROM (SELECT {key}, unnest({_TOKENS}) AS t FROM {table}) GROUP BY ALL),
{of} AS (SELECT {key}, dim, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS w FROM {of}c)"""

    return f"""{side(name + '_d', 'doc_id', docs)}, {side(name + '_q', 'query_id', '(SELECT item_id AS query_id, text FROM benchmark)')},
{name} AS (SELECT q.query_id, d.doc_id, round(sum(d.w * q.w), 6) AS score FROM {name}_d d JOIN {name}_q q USING (dim) GROUP BY ALL)"""


def _top(name: str, of: str, k: int, id_col: str = "doc_id") -> str:
    return f"""{name} AS (SELECT query_id, {id_col}, score, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {id_col})::INT AS rank FROM {of}) WHERE rank <= {k})"""


_QUESTIONS = f"""lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+')) >= 3)[1:3] AS ls FROM corpus),
questions AS (SELECT doc_id AS of_doc, unnest(ls) AS text, unnest(range(len(ls))) AS position FROM lines),
{_bow('near', '(SELECT of_doc * 3 + position AS doc_id, text FROM questions)')},
by_question AS (SELECT query_id, of_doc AS doc_id, max(score) AS score FROM near JOIN questions ON near.doc_id = of_doc * 3 + position GROUP BY ALL), {_top('asked_top', 'by_question', 20)}"""


def _fused(name: str, weight: float) -> str:
    return f"""{name} AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 8) AS score
  FROM (SELECT *, 1.0::DOUBLE AS w FROM lex_top UNION ALL SELECT *, 1.0::DOUBLE FROM bow_top UNION ALL SELECT *, {weight}::DOUBLE FROM asked_top) GROUP BY ALL)"""


_HYBRID = f"""WITH {_CORPUS}, {_bm25('lex', 'corpus', True)}, {_bow('bow', 'corpus')}, {_QUESTIONS}, {_top('lex_top', 'lex', 20)}, {_top('bow_top', 'bow', 20)},
{_fused('fused', 0.15)}, {_top('found', 'fused', 10)}"""
_COSINE = "list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0)"
_PAIRS = f"""WITH vs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(coalesce({_COSINE}, 0), 6) AS score
  FROM vs a JOIN vs b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"""
_ENTITIES = f"""WITH ents AS (SELECT doc_id, entity, freq FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, entity) AS n FROM (
    SELECT doc_id, entity, count(*) AS freq FROM (SELECT doc_id, unnest({_TOKENS}) AS entity FROM documents)
    WHERE length(entity) > 1 AND entity NOT IN ({_STOP}) GROUP BY ALL HAVING count(*) >= 2)) WHERE n <= 200)"""
_RELATIONS = f"""{_ENTITIES}, df AS (SELECT entity, count(DISTINCT doc_id) AS df FROM ents GROUP BY entity),
w AS (SELECT doc_id, entity, df, freq * (ln((1 + (SELECT count(DISTINCT doc_id) FROM ents))::DOUBLE / (1 + df)) + 1) AS w FROM ents JOIN df USING (entity)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm, count(*) AS size FROM w GROUP BY doc_id),
shared AS (SELECT a.doc_id AS source, b.doc_id AS target, sum(a.w * b.w) AS d, count(*) AS n FROM w a JOIN w b ON a.entity = b.entity AND a.doc_id <> b.doc_id
  WHERE a.doc_id % 20 = 0 AND (b.doc_id % 20 <> 0 OR a.doc_id < b.doc_id) GROUP BY ALL),
r AS (SELECT source, target, round(d / (x.norm * y.norm), 6) AS cosine, round(n::DOUBLE / (x.size + y.size - n), 6) AS jaccard
  FROM shared JOIN norms x ON x.doc_id = source JOIN norms y ON y.doc_id = target),
rels AS (SELECT *, CASE WHEN jaccard >= 0.5 THEN 'duplicate' ELSE 'complementary' END AS relation FROM r WHERE cosine >= 0.3)"""
#: Text columns of the star tables.
TEXTS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"],
}
_ENUMS = " UNION ".join(f"SELECT '{c}' AS col, {c} AS value FROM {t} WHERE {c} IS NOT NULL" for t, cs in TEXTS.items() for c in cs)
_SALES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_AMOUNT = "l_extendedprice * (1 - l_discount)"
_PLACED = f"{_SALES} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_PART = f"{_SALES} JOIN part ON l_partkey = p_partkey"
_TOK = "CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, floor(length(text) / 1.5::DOUBLE)) END::BIGINT"
_WINDOW = f"""SELECT conv_id, turn, tokens, used FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used
  FROM (SELECT conv_id, turn, {_TOK} AS tokens FROM conversations WHERE text IS NOT NULL AND text <> '')) WHERE used <= 1500"""
_SEEN = "(visibility = 'public' OR (visibility IN ('internal', 'restricted') AND role IN ({roles})) OR {owner})"

_LABELLED = f"""{_PAIRS}, means AS (SELECT label, list(x ORDER BY dim) AS v FROM (
  SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS dim FROM vs) GROUP BY ALL) GROUP BY label),
near AS (SELECT b.vec_id AS query_id, a.label, round(coalesce({_COSINE}, 0), 6) AS score FROM means a JOIN vs b ON b.vec_id % 100 = 0)"""
_FOUND = f"{_HYBRID}, hits AS (SELECT query_id, doc_id, score, rank, kb_id, text FROM found JOIN corpus USING (doc_id))"


def _values(name: str, of: str, group: str) -> str:
    return rf"""{name}_lines AS (SELECT {group}, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS section FROM (SELECT *, string_split(text, chr(10)) AS lines FROM {of})),
{name}_pairs AS (SELECT *, string_split(unnest(regexp_extract_all(line, '\p{{L}}+ [0-9]+(?:\.[0-9]+)?')), ' ') AS p FROM {name}_lines),
{name}_counts AS (SELECT {group}, lower(p[1]) AS name, count(DISTINCT p[2]) AS n_values, count(DISTINCT doc_id) AS n_docs, count(DISTINCT (doc_id, section)) AS n_sections FROM {name}_pairs GROUP BY ALL),
{name} AS (SELECT {group}, name, n_values, n_docs, CASE WHEN n_docs = 1 AND n_sections > 1 THEN 'section_mismatch' ELSE 'value_mismatch' END AS kind,
  CASE WHEN n_docs = 1 AND n_sections > 1 THEN 'medium' ELSE 'high' END AS severity FROM {name}_counts WHERE n_values > 1)"""


def _html(column: str) -> str:
    for pattern, by in HTML_STEPS:
        quoted = [x.replace("'", "''") for x in (pattern, by)]
        column = f"regexp_replace({column}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return column


ORACLES = {
    "lexical_bm25_topk": f"WITH {_CORPUS}, {_bm25('lex', 'corpus', True)}, {_top('t', 'lex', 20)} SELECT * FROM t",
    "lexical_grown_index": f"WITH {_CORPUS}, {_bm25('lex', 'corpus', True)}, {_top('t', 'lex', 20)} SELECT * FROM t",
    "lexical_relaxed": f"WITH {_CORPUS}, {_bm25('lex', 'corpus', False)}, {_top('t', 'lex', 20)} SELECT * FROM t",
    "bow_cosine_topk": f"WITH {_CORPUS}, {_bow('bow', 'corpus')}, {_top('t', 'bow', 20)} SELECT * FROM t",
    "question_topk": f"WITH {_CORPUS}, {_QUESTIONS} SELECT * FROM asked_top",
    "scoped_search": f"WITH {_CORPUS}, scoped AS (SELECT * FROM corpus WHERE lang IN ('en', 'de') AND kb_id IN ('src0', 'src1', 'src2', 'src3') AND doc_id < 5000 AND doc_id % 2 = 0), {_bow('bow', 'scoped')}, {_top('t', 'bow', 10)} SELECT * FROM t",
    "hybrid_rrf": f"{_HYBRID} SELECT * FROM found",
    "acl_filtered_search": f"WITH {_CORPUS}, seen AS (SELECT * FROM corpus WHERE {_SEEN.format(roles='1, 2', owner='owner = 3')}), {_bow('bow', 'seen')}, {_top('t', 'bow', 10)} SELECT * FROM t",
    "hybrid_rrf_fallback": f"""WITH {_CORPUS}, kb AS (SELECT * FROM corpus WHERE kb_id = 'src1'), {_bm25('lex', 'kb', True)}, {_bm25('wide', 'kb', False)}, {_top('t', 'lex', 10)},
enough AS (SELECT query_id FROM t GROUP BY query_id HAVING count(*) >= 10),
unseen AS (SELECT * FROM wide WHERE query_id NOT IN (FROM enough) AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM t)), {_top('extra', 'unseen', 10)},
every AS (SELECT query_id, doc_id, score FROM t UNION ALL SELECT query_id, doc_id, round(0.5::DOUBLE / (60 + rank), 8) FROM extra), {_top('final', 'every', 10)} SELECT * FROM final""",
    "fusion_per_kb": f"""WITH {_CORPUS}, {_bow('bow', 'corpus')}, r AS (SELECT query_id, kb_id, doc_id, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, doc_id) AS rank
  FROM bow JOIN corpus USING (doc_id)), five AS (SELECT query_id, kb_id, doc_id, round(1.0::DOUBLE / (60 + rank), 8) AS score FROM r WHERE rank <= 5),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM five
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY kb_id, score DESC) = 1) SELECT query_id, kb_id, doc_id, score, rank FROM m WHERE rank <= 30""",
    "per_doc_diverse": f"""WITH {_CORPUS}, {_bow('bow', 'corpus')}, {_top('t', 'bow', 20)},
g AS (SELECT t.query_id, t.doc_id, kb_id, rank, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY rank) > 1 AS again FROM t JOIN corpus USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY again, rank)::INT AS place FROM g) SELECT query_id, doc_id, kb_id, place FROM p WHERE place <= 5""",
    "vector_topk": f"{_PAIRS}, {_top('t', 'scored', 10, 'vec_id')} SELECT * FROM t",
    "question_channel_min": f"{_PAIRS} SELECT query_id, label, max(score) AS score FROM scored GROUP BY ALL",
    "doc_mean_pool": "SELECT label, dim - 1 AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1))::INT AS dim FROM embeddings) GROUP BY ALL",
    "entity_tf": f"{_ENTITIES} SELECT * FROM ents",
    "entity_df": f"{_ENTITIES} SELECT entity, count(DISTINCT doc_id) AS df FROM ents GROUP BY entity",
    "relation_class": f"{_RELATIONS} SELECT * FROM rels",
    "cross_doc_neighbors": f"""{_RELATIONS}, {_HYBRID[5:]}, edges AS (SELECT source AS doc_id, target AS other, cosine FROM rels WHERE relation = 'complementary'
  UNION ALL SELECT target, source, cosine FROM rels WHERE relation = 'complementary'),
asked AS (SELECT query_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY freq DESC, entity) AS n FROM (
  SELECT query_id, entity, count(*) AS freq FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS entity FROM benchmark)
  WHERE length(entity) > 1 AND entity NOT IN ({_STOP}) GROUP BY ALL)) WHERE n <= 200),
worded AS (SELECT query_id, doc_id, round(count(*)::DOUBLE / any_value(n), 6) AS score FROM asked JOIN ents USING (entity)
  JOIN (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id) USING (query_id) GROUP BY query_id, doc_id),
every AS (SELECT query_id, other AS doc_id, cosine AS score FROM found JOIN edges USING (doc_id) UNION ALL SELECT * FROM worded WHERE score >= 0.2
  UNION ALL SELECT query_id, doc_id, score FROM bow WHERE score >= 0.7),
best AS (SELECT query_id, doc_id, max(score) AS score FROM every WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.query_id = every.query_id AND f.doc_id = every.doc_id) GROUP BY ALL),
{_top('t', 'best', 5)} SELECT * FROM t""",
    "html_pages": f"SELECT page_id, {_html('html')} AS text FROM pages",
    "kb_list_visible": f"WITH {_CORPUS} SELECT kb_id, count(*) AS n FROM corpus WHERE {_SEEN.format(roles='1', owner='owner = 2')} GROUP BY kb_id",
    "kb_denied": f"WITH {_CORPUS} SELECT DISTINCT kb_id FROM corpus WHERE kb_id NOT IN (SELECT kb_id FROM corpus WHERE visibility <> 'public' AND role = 1 AND kb_id IS NOT NULL)",
    "content_hash_dups": "SELECT sha256(coalesce(text, '')) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "incremental_reuse": "SELECT doc_id, md5(coalesce(text, '')) IN (SELECT md5(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0) AS reused FROM documents",
    "chunk_ids": """WITH h AS (SELECT doc_id, source AS kb_id, substr(sha256(text), 1, 10) AS hash FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY kb_id, hash ORDER BY doc_id) - 1 AS n FROM h)
SELECT doc_id, concat_ws('_', kb_id, hash, CASE WHEN n > 0 THEN n END) AS chunk_id FROM n""",
    "page_noise": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT *, trim(line) AS t, count(*) OVER (PARTITION BY doc_id, trim(line)) AS n FROM l)
SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM c
WHERE NOT regexp_full_match(t, '\d+\s*/\s*\d+') AND NOT (length(t) < 40 AND length(t) > 0 AND n >= 5) GROUP BY doc_id""",
    "extract_years": "SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '20[0-9]{2}'))) AS year FROM documents",
    "pii_luhn_valid": """WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{15,19}')) AS digits FROM documents),
d AS (SELECT *, list_transform(string_split(reverse(digits), ''), lambda c: c::INT) AS d FROM f)
SELECT doc_id, digits, list_sum(list_transform(d, lambda x, i: CASE WHEN i % 2 = 0 THEN CASE WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END ELSE x END)) % 10 = 0 AS valid,
       left(digits, 3) || repeat('*', length(digits) - 7) || right(digits, 4) AS masked FROM d""",
    "pii_scan_counts": r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::INT AS mails,
  len(regexp_extract_all(coalesce(text, ''), '[0-9]{3}[- ][0-9]{3,4}[- ][0-9]{4}'))::INT AS phones FROM documents) SELECT * FROM c WHERE mails + phones > 0""",
    "token_estimates": f"SELECT conv_id, turn, {_TOK} AS tokens FROM conversations",
    "memory_window": _WINDOW,
    "summary_trigger": f"""WITH kept AS (SELECT conv_id, min(turn) AS boundary FROM ({_WINDOW}) GROUP BY conv_id)
SELECT c.conv_id, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM conversations c LEFT JOIN kept USING (conv_id) WHERE boundary IS NULL OR turn < boundary GROUP BY c.conv_id""",
    "neighbor_context": """SELECT conv_id, turn, md5(coalesce(string_agg(text, chr(10)) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS before,
  md5(coalesce(string_agg(text, chr(10)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '')) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "conversation_titles": "SELECT conv_id, substr(arg_min(text, turn), 1, 30) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "eval_metrics": f"""{_HYBRID}, gold AS (SELECT item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
g AS (SELECT query_id, count(DISTINCT doc_id) AS gold FROM gold GROUP BY query_id),
h AS (SELECT query_id, count(*) AS got, min(rank) AS first, max(rank <= 5)::INT AS hit5 FROM found JOIN gold USING (query_id, doc_id) GROUP BY query_id)
SELECT item_id AS query_id, coalesce(hit5, 0)::INT AS hit5, (coalesce(got, 0) > 0)::INT AS hit10, round(coalesce(got::DOUBLE / gold, 0), 6) AS recall10,
  round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr FROM benchmark LEFT JOIN g ON g.query_id = item_id LEFT JOIN h ON h.query_id = item_id""",
    "eval_latency_pctl": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = floor(0.5::DOUBLE * n)) AS p50, max(value) FILTER (i = floor(0.95::DOUBLE * n)) AS p95 FROM r GROUP BY event_type""",
    "score_by_category": "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good, round(avg(quality), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "eval_transitions": f"""{_HYBRID}, {_fused('plain', 0.0)}, {_top('found_off', 'plain', 10)},
gold AS (SELECT item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
off AS (SELECT query_id, min(rank) AS off FROM found_off JOIN gold USING (query_id, doc_id) GROUP BY ALL),
lit AS (SELECT query_id, min(rank) AS lit FROM found JOIN gold USING (query_id, doc_id) GROUP BY ALL),
cells AS (SELECT CASE WHEN off = 1 THEN 'first' WHEN off IS NOT NULL THEN 'found' ELSE 'missed' END AS before,
  CASE WHEN lit = 1 THEN 'first' WHEN lit IS NOT NULL THEN 'found' ELSE 'missed' END AS after FROM benchmark LEFT JOIN off ON off.query_id = item_id LEFT JOIN lit ON lit.query_id = item_id)
SELECT before, after, count(*) AS n FROM cells GROUP BY ALL""",
    "introspect_enums": f"""WITH v AS ({_ENUMS}) SELECT col, value FROM v WHERE col IN (SELECT col FROM v GROUP BY col HAVING count(*) <= 20)""",
    "progress_throttle": """WITH b AS (SELECT event_id, user_id, event_type, floor(value / 5)::BIGINT AS bucket, lag(floor(value / 5)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)
SELECT event_id, user_id, bucket FROM b WHERE last IS NULL OR last <> bucket OR event_type IN ('purchase', 'error')""",
    "throttle_stream": """WITH known AS (SELECT * FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), passed AS (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 AS us FROM known),
b AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, floor(value / 5)::BIGINT AS bucket, lag(floor(value / 5)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM known)
SELECT event_id, user_id, bucket FROM b, passed WHERE b.us <= passed.us AND (last IS NULL OR last <> bucket OR event_type IN ('purchase', 'error'))""",
    "rate_limit_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS n FROM events",
    "token_bucket": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT *, max(us - i * 1200000000) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + i * 1200000000 AS full_at FROM e)
SELECT event_id, user_id, greatest(0, coalesce(full_at - 2400000000 - us, 0))::BIGINT AS waited FROM m""",
    "vector_topk_filtered": f"{_PAIRS}, chosen AS (SELECT * FROM scored WHERE label IN (1, 2, 3)), {_top('t', 'chosen', 10, 'vec_id')} SELECT * FROM t",
    "two_stage_docs": f"""{_LABELLED}, wide AS (SELECT * FROM near WHERE score >= 0.3), {_top('five', 'wide', 5, 'label')},
s AS (SELECT scored.* FROM scored JOIN five USING (query_id, label)), {_top('t', 's', 10, 'vec_id')} SELECT * FROM t""",
    "per_doc_cap": "SELECT conv_id, turn, n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS n FROM conversations) WHERE n <= 10",
    "chunk_diff": """WITH s AS (SELECT source AS kb_id, md5(coalesce(text, '')) AS hash, max(doc_id % 3 <> 0) AS old, max(doc_id % 3 <> 1) AS new FROM documents GROUP BY ALL)
SELECT kb_id, hash, CASE WHEN NOT new THEN 'delete' WHEN NOT old THEN 'insert' ELSE 'reuse' END AS action FROM s""",
    "rerank_reorder": f"""{_FOUND}, asked AS (SELECT item_id AS query_id, list_distinct({_TOKENS}) AS q FROM benchmark),
r AS (SELECT query_id, doc_id, rank, round(len(list_intersect(q, {_TOKENS}))::DOUBLE / nullif(len(q), 0), 6) AS relevance FROM hits JOIN asked USING (query_id)),
o AS (SELECT *, coalesce(max(relevance) OVER (PARTITION BY query_id) - min(relevance) OVER (PARTITION BY query_id), 0) > 0.001 AS told FROM r)
SELECT query_id, doc_id, relevance, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN told THEN relevance END DESC NULLS LAST, rank)::INT AS place FROM o""",
    "prompt_budget": f"""{_FOUND}, u AS (SELECT *, length(coalesce(text, '')) AS n, sum({_TOK} + 20) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM hits)
SELECT query_id, doc_id, rank, (CASE WHEN used <= 6000 THEN n ELSE least(n, 8980) END)::INT AS chars FROM u WHERE used <= 6000 OR rank = 1""",
    "conflict_keys": f"WITH {_CORPUS}, {_values('c', 'corpus', 'kb_id')} SELECT * FROM c",
    "evidence_gate": f"""{_FOUND}, {_values('c', 'hits', 'query_id')},
have AS (SELECT DISTINCT query_id, unnest({_TOKENS}) AS term FROM hits),
share AS (SELECT query_id, count(*) AS slots, count(have.term) AS covered FROM lex_terms LEFT JOIN have USING (query_id, term) GROUP BY query_id),
clash AS (SELECT query_id, max(severity = 'high') AS high FROM c GROUP BY query_id)
SELECT query_id, slots, covered, round(covered::DOUBLE / slots, 6) AS coverage, coalesce(high, false) AS conflict,
  coalesce(high, false) OR round(covered::DOUBLE / slots, 6) < 0.7 AS refused FROM share LEFT JOIN clash USING (query_id)""",
    "faq_filter_rate_by_group": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, (20000 * count(*) FILTER (o_orderstatus = 'F') + count(*)) // (2 * count(*)) / 100.0::DOUBLE AS rate FROM orders GROUP BY 1",
    "faq_return_reason": "SELECT l_returnflag, count(*) AS n, ((20000 * count(*) + sum(count(*)) OVER ()) // (2 * sum(count(*)) OVER ()))::BIGINT / 100.0::DOUBLE AS share FROM lineitem GROUP BY 1",
    "faq_region_rank": f"SELECT r_name, round(sum({_AMOUNT}), 2) AS sales FROM {_PLACED} GROUP BY r_name",
    "faq_monthly_trend": f"SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum({_AMOUNT}), 2) AS sales, count(*) AS n FROM {_SALES} GROUP BY 1",
    "faq_category_share": f"SELECT p_type, round(sum({_AMOUNT}) / sum(sum({_AMOUNT})) OVER () * 100, 2) AS share FROM {_PART} GROUP BY p_type",
    "faq_segment": f"SELECT c_mktsegment, round(sum({_AMOUNT}), 2) AS sales, count(DISTINCT c_custkey) AS customers FROM {_PLACED} GROUP BY 1",
    "faq_top_customers": f"SELECT c_custkey, round(sum({_AMOUNT}), 2) AS sales FROM {_PLACED} GROUP BY 1 ORDER BY sales DESC, c_custkey LIMIT 10",
    "faq_yoy": f"""WITH y AS (SELECT year(o_orderdate)::INT AS year, sum({_AMOUNT}) AS s FROM {_SALES} GROUP BY 1)
SELECT a.year, round(a.s, 2) AS sales, round((a.s - b.s) / nullif(b.s, 0) * 100, 2) AS growth FROM y a LEFT JOIN y b ON a.year = b.year + 1""",
    "faq_channel": f"SELECT o_orderpriority, round(sum({_AMOUNT}), 2) AS sales, count(DISTINCT o_orderkey) AS orders FROM {_SALES} GROUP BY 1",
    "faq_nation_rank": f"WITH s AS (SELECT n_name, round(sum({_AMOUNT}), 2) AS sales FROM {_PLACED} GROUP BY 1) SELECT *, rank() OVER (ORDER BY sales DESC)::INT AS rank FROM s",
    "faq_return_rate": "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS returned, (20000 * count(*) FILTER (l_returnflag = 'R') + count(*)) // (2 * count(*)) / 100.0::DOUBLE AS rate FROM lineitem GROUP BY 1",
    "faq_product_return_top": "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10",
    "faq_latest_snapshot": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) GROUP BY 1",
    "faq_turnover": """WITH s AS (SELECT l_partkey, sum(l_quantity) AS sold FROM lineitem GROUP BY 1), h AS (SELECT l_partkey, sum(l_quantity) AS held FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_partkey, (200 * round(sold * 100)::BIGINT + round(held * 100)::BIGINT) // (2 * nullif(round(held * 100)::BIGINT, 0)) / 100.0::DOUBLE AS turnover FROM s JOIN h USING (l_partkey)""",
    "faq_filter_rate": "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, (20000 * count(*) FILTER (o_orderstatus = 'F') + count(*)) // (2 * count(*)) / 100.0::DOUBLE AS rate FROM orders",
    "faq_weekend": f"SELECT dayofweek(o_orderdate) IN (0, 6) AS weekend, round(sum({_AMOUNT}), 2) AS sales, count(*) AS n FROM {_SALES} GROUP BY 1",
    "faq_half_open": "SELECT quarter(o_orderdate)::INT AS quarter, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1",
    "faq_margin_top": f"SELECT p_brand, round(sum({_AMOUNT} - p_retailprice), 2) AS margin FROM {_PART} GROUP BY 1 ORDER BY margin DESC, p_brand LIMIT 10",
    "faq_brand": f"SELECT p_brand, round(sum({_AMOUNT}), 2) AS sales, round(avg(l_quantity), 2) AS mean_quantity FROM {_PART} GROUP BY 1",
}
