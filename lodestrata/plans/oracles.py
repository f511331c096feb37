"""DuckDB SQL that says the same as plans.queries, where SQL can."""

from __future__ import annotations

from lodestrata.functions.text import QUERY_STOP_WORDS
from lodestrata.operators.prompts import INSTRUCTION, NO_CONTEXT, UNSUPPORTED

_U = "u AS (SELECT * FROM units WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY received_at DESC NULLS LAST) = 1)"
_EL = "el AS (SELECT * FROM elements WHERE element_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY received_at DESC NULLS LAST) = 1)"
_EX = (
    "ex AS (SELECT record_no AS query_id, dataset, split, example_id, question.document_id AS document_id, question.text AS query_text, reference_answer.text AS answer, "
    "reference_answer.program AS program, reference_answer.normalized_program AS normalized_program, reference_answer.explanation AS explanation, len(reference_answer.steps) AS n_steps, question.metadata['source_file'] AS source_file, supporting_facts FROM examples WHERE record_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_no ORDER BY received_at DESC NULLS LAST) = 1)"
)
_FACTS = "facts AS (SELECT query_id, document_id, position, trim(f.element_id) AS element_id, f.source_key AS source_key FROM (SELECT query_id, document_id, unnest(range(len(supporting_facts))) AS position, unnest(supporting_facts) AS f FROM ex))"
_RE = "re AS (SELECT * FROM rag_export WHERE record_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_no ORDER BY received_at DESC NULLS LAST) = 1)"
_LINEAGE = "lineage AS (SELECT DISTINCT chunk_id, document_id, unnest(source_element_ids) AS element_id FROM u)"
_STOP = ", ".join(f"'{w}'" for w in QUERY_STOP_WORDS)


def _tokens(column: str) -> str:
    return rf"regexp_extract_all(replace(lower({column}), 'ß', 'ss'), '[\pL\pN]+(?:[.,][\pL\pN]+)*|[$€£¥%]')"


def _query_tokens(column: str) -> str:
    distinct = f"list_filter({_tokens(column)}, lambda x, i: list_position({_tokens(column)}, x) = i)"
    kept = f"list_filter({distinct}, lambda x: x NOT IN ({_STOP}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {distinct} END"


def _bm25(k: int = 5, variant: str = "okapi", normalized: bool = False, name: str = "rk") -> str:
    words = _query_tokens("query_text") if normalized else _tokens("query_text")
    idf = "ln(n + 1.0) - ln(df)" if variant == "plus" else "CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END"
    base = "coalesce(b.base, 0.0)" if variant == "plus" else "0.0"
    return f"""
tok AS (SELECT document_id, chunk_id, unnest({_tokens('text')}) AS term FROM u),
tf AS (SELECT document_id, chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT document_id, chunk_id, count(*) AS dl FROM tok GROUP BY ALL),
sz AS (SELECT document_id, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY ALL),
dfs AS (SELECT document_id, term, count(*) AS df FROM tf GROUP BY ALL),
raws AS (SELECT document_id, term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs JOIN sz USING (document_id)),
idfs AS (SELECT document_id, term, avgdl, {idf} AS idf FROM raws JOIN (SELECT document_id, avg(raw) AS m FROM raws GROUP BY ALL) USING (document_id)),
qt AS (SELECT query_id, document_id, term, count(*) AS times FROM (SELECT query_id, document_id, unnest({words}) AS term FROM ex) GROUP BY ALL),
bases AS (SELECT query_id, sum(times * idf) AS base FROM qt JOIN idfs USING (document_id, term) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, sum(times * idf * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)))) AS score
       FROM qt JOIN idfs USING (document_id, term) JOIN tf USING (document_id, term) JOIN lens USING (document_id, chunk_id) GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
       FROM (SELECT q.query_id, l.chunk_id, coalesce(sc.score, 0) + {base} AS score
             FROM (SELECT DISTINCT query_id, document_id FROM qt) q JOIN lens l USING (document_id)
             LEFT JOIN sc ON sc.query_id = q.query_id AND sc.chunk_id = l.chunk_id LEFT JOIN bases b ON b.query_id = q.query_id)
       QUALIFY rank <= {k})"""


def _dense(k: int = 5, name: str = "dk") -> str:
    def vector(source: str, key: str, column: str) -> str:
        return f"""(SELECT {key}, document_id, i, sum(sign) AS v FROM (
  SELECT {key}, document_id, h % 32 AS i, CASE WHEN (h // 32) % 2 = 0 THEN 1.0e0 ELSE -1.0e0 END AS sign
  FROM (SELECT {key}, document_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM (SELECT {key}, document_id, unnest({_tokens(column)}) AS t FROM {source}))) GROUP BY ALL)"""

    return f"""
uv AS {vector('u', 'chunk_id', 'text')},
qv AS {vector('ex', 'query_id', 'query_text')},
un AS (SELECT chunk_id, document_id, sqrt(sum(v * v)) AS norm FROM uv GROUP BY ALL HAVING sum(v * v) > 0),
qn AS (SELECT query_id, document_id, sqrt(sum(v * v)) AS norm FROM qv GROUP BY ALL HAVING sum(v * v) > 0),
dots AS (SELECT query_id, chunk_id, sum(qv.v * uv.v) AS dot FROM qv JOIN uv USING (document_id, i) GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
       FROM (SELECT qn.query_id, un.chunk_id, coalesce(dot, 0) / (qn.norm * un.norm) AS score FROM qn JOIN un USING (document_id) LEFT JOIN dots d ON d.query_id = qn.query_id AND d.chunk_id = un.chunk_id)
       QUALIFY rank <= {k})"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _evaluated(rank: str, out: str) -> str:
    ks = ", ".join(f"(count(CASE WHEN rank <= {k} THEN 1 END) > 0)::INT AS hit_{k}, count(CASE WHEN rank <= {k} THEN 1 END) / count(*) AS recall_{k}" for k in (1, 3, 5))
    return f"""{out} AS (SELECT query_id, min(rank) AS first_relevant_rank, count(*) AS n_gold, {ks}
FROM (SELECT g.query_id, g.element_id, min(r.rank) AS rank
      FROM (SELECT DISTINCT query_id, element_id FROM facts WHERE element_id <> '') g
      LEFT JOIN (SELECT {rank}.query_id, element_id, rank FROM {rank} JOIN lineage USING (chunk_id)) r ON r.query_id = g.query_id AND r.element_id = g.element_id GROUP BY ALL)
GROUP BY query_id)"""


def _rolled(evals: str, out: str) -> str:
    ks = ", ".join(f"avg(hit_{k}) AS hit_{k}, avg(recall_{k}) AS recall_{k}" for k in (1, 3, 5))
    return f"{out} AS (SELECT CASE WHEN grouping(dataset) = 1 THEN 'combined' ELSE dataset END AS scope, count(*) AS n_queries, {ks}, avg(coalesce(1.0 / first_relevant_rank, 0)) AS mrr FROM {evals} JOIN (SELECT query_id, dataset FROM ex) USING (query_id) GROUP BY GROUPING SETS ((dataset), ()))"


_METRICS = [f"{m}_{k}" for k in (1, 3, 5) for m in ("hit", "recall")] + ["mrr"]
_WINDOWS = """
SELECT doc_id, i::INT AS chunk_index, i * 2200 AS char_start, least(length(text), i * 2200 + 2750) AS char_end, substr(text, i * 2200 + 1, 2750) AS piece
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 2750 THEN 1 ELSE ceil((length(text) - 2750) / 2200)::BIGINT + 1 END)) AS i FROM documents WHERE length(text) > 0)"""
_ORDER_ROWS = """
SELECT DISTINCT l_orderkey::VARCHAR AS document_id, 'order:' || l_orderkey AS parent_chunk_id,
  'Table: Order ' || l_orderkey || chr(10) || 'line: ' || l_linenumber || ' | part: ' || l_partkey || ' | quantity: ' || l_quantity::BIGINT AS text
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
_GROUPED = r"""
p AS (SELECT *, replace(lower(regexp_replace(replace(coalesce(CASE WHEN trim(source_file) <> '' THEN source_file END, document_id), '\', '/'), '^\s+|\s+$', '', 'g')), 'ß', 'ss') AS p FROM {0}),
q AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM p),
r AS (SELECT * EXCLUDE (p, parts), CASE WHEN len(parts) + starts_with(p, '/')::INT >= 3 AND starts_with(parts[-1], 'page_') THEN CASE WHEN starts_with(p, '/') THEN '/' ELSE '' END || array_to_string(parts[:-2], '/') ELSE p END AS report FROM q),
g AS (SELECT * EXCLUDE (report), 'source-group:' || substr(sha256(unhex(printf('%016x', strlen(report))) || encode(report)), 1, 24) AS group_id FROM r)"""
_ASSIGNED = "CASE WHEN ('0x' || substr(sha256(group_id), 1, 8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x' || substr(sha256(group_id), 1, 8))::BIGINT % 100 < 90 THEN 'validation' ELSE 'test' END"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), 'ß', 'ss'), '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '[^a-z0-9%.$-]+', ' ', 'g'))"
_EVIDENCE_TOKENS = r"list_distinct(regexp_extract_all({0}, '-?\$?[0-9]+(?:\.[0-9]+)?%?|[a-z]+'))"
_ROW = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\pL\pN_%.$-]+', ' ', 'g'))"
_PARENT = "document_id, CASE WHEN len(parent_source_element_ids) > 0 THEN parent_source_element_ids ELSE [coalesce(nullif(trim(parent_chunk_id, ' '), ''), chunk_id)] END"
_LINK = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\s+', ' ', 'g'))"
_PAGE = "CASE WHEN page_start = page_end THEN page_start::VARCHAR ELSE page_start || '-' || page_end END"
_LINKED = f"""linked AS (
  SELECT re.record_no AS record_id, re.dataset,
    CASE WHEN e.n = 1 THEN 'exact' WHEN e.n > 1 AND e.s = 1 THEN 'equivalent' WHEN e.n > 1 THEN 'ambiguous' WHEN a.q IS NOT NULL THEN 'answer_mismatch' ELSE 'ambiguous' END AS link_status, e.id
  FROM re
  LEFT JOIN (SELECT {_LINK.format('query_text')} AS q, {_LINK.format('answer')} AS a, count(*) AS n, count(DISTINCT concat_ws('|', document_id, program)) AS s, min(query_id) AS id FROM ex GROUP BY ALL) e
    ON e.q = {_LINK.format('re.question')} AND e.a = {_LINK.format('re.expected_values[1]')}
  LEFT JOIN (SELECT DISTINCT {_LINK.format('query_text')} AS q FROM ex) a ON a.q = {_LINK.format('re.question')})"""
def _answered(right: str = "record_no % 2 = 0", n: str = "") -> str:
    return f"""answered{n} AS (
  SELECT record_no, category, context_mode, coalesce(answerable, FALSE) AS able, answerable, expected_values, expected_units,
    CASE WHEN NOT answerable AND record_no % 3 <> 0 THEN '{UNSUPPORTED}'
      ELSE 'From 1 + 2 = 3 and the notes, the answer is ' || coalesce(expected_values[1], 'unknown') || CASE WHEN {right} THEN ' [Source 1].' ELSE ' [Source 7].' END END AS answer
  FROM re),
parsed{n} AS (
  SELECT *, lower(trim(regexp_replace(answer, '\\s+', ' ', 'g'))) AS plain,
    list_filter(list_transform(regexp_extract_all(CASE WHEN answer = '{UNSUPPORTED}' THEN answer ELSE coalesce(expected_values[1], 'unknown') || '.' END, '(?:^|[^\\pL\\pN_.])([-+]?(?:[0-9][0-9,]*(?:\\.[0-9]+)?|\\.[0-9]+))(?:[^\\pL\\pN_]|$)', 1), lambda x: try_cast(replace(x, ',', '') AS DECIMAL(38,10))), lambda x: x IS NOT NULL) AS numbers,
    list_filter(list_transform(coalesce(expected_values, []), lambda x: try_cast(replace(x, ',', '') AS DECIMAL(38,10))), lambda x: x IS NOT NULL) AS wanted
  FROM answered{n}),
flagged{n} AS (
  SELECT record_no, category, context_mode, able,
    CASE WHEN able THEN answer <> '{UNSUPPORTED}' ELSE answer = '{UNSUPPORTED}' END AS refusal,
    CASE WHEN len(wanted) > 0 THEN len(list_filter(wanted, lambda w: list_contains(numbers, w))) = len(wanted) END AS numeric,
    CASE WHEN len(expected_units) > 0 THEN len(list_filter(expected_units, lambda x: contains(plain, lower(trim(x))))) = len(expected_units) END AS units,
    CASE WHEN answerable THEN ({right}) AND answer <> '{UNSUPPORTED}' END AS citations
  FROM parsed{n}),
scored{n} AS (
  SELECT *, content AND refusal AND coalesce(numeric, TRUE) AND coalesce(units, TRUE) AND coalesce(citations, TRUE) AS overall
  FROM (SELECT *, CASE WHEN able THEN coalesce(numeric, TRUE) ELSE refusal END AS content FROM flagged{n}))"""


_SHOWN_NUMBER = "[-+]?(?:[0-9][0-9,]*(?:\\.[0-9]+)?|\\.[0-9]+)"
_GUARD = "shown AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM rk JOIN u USING (chunk_id) GROUP BY query_id)"


def _count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[\\pL\\pN_]+|[^\\pL\\pN_\\s\\pZ\\x0b\\x85]'))"


def _framed(*parts: str) -> str:
    return " || ".join(f"unhex(printf('%016x', strlen({p}))) || encode({p})" for p in parts)


def _gives_away(context: str, answer: str) -> str:
    """Whether a context holds the answer. A number's neighbours are taken with it and cut off, since RE2 looks neither back nor ahead; signs between are doubled so that neighbours don't overlap."""
    bare = f"rtrim(regexp_replace({answer}, '^\\s+|\\s+$', '', 'g'), '.')"
    spaced = f"regexp_replace({context}, '([^0-9,.A-Za-z_+-])', '\\1\\1', 'g')"
    numbers = f"list_filter(list_transform(regexp_extract_all({spaced}, '(?:^|[^A-Za-z0-9_.])({_SHOWN_NUMBER})(?:[^A-Za-z0-9_]|$)', 1), lambda x: try_cast(replace(x, ',', '') AS DECIMAL(38,10))), lambda x: x IS NOT NULL)"
    return f"CASE WHEN regexp_matches({bare}, '^[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?$') THEN list_contains({numbers}, try_cast(replace({bare}, ',', '') AS DECIMAL(38,10))) ELSE contains(replace(lower({context}), 'ß', 'ss'), replace(lower({bare}), 'ß', 'ss')) END"

def _unique(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i AND coalesce(x, '') <> '')"


def _unit_steps(source: str, out: str) -> str:
    """Steps from source (query_id, answer, question, evidence, program, ...) to out with u_text, u_units and u_status."""
    word = "percent|percentage|basis points?|thousand|million|billion"
    number = "[-+]?(?:[0-9][0-9,]*(?:\\.[0-9]+)?|\\.[0-9]+)"
    place = f"(?:^|[^A-Za-z0-9_.$€£]|([$€£])\\s{{0,4}})({number})(\\s*%|\\s+(?:thousand|million|billion|basis\\s+points?)\\b|[^A-Za-z0-9_]|$)"
    explicit = f"(?i)[$€£%]|\\b(?:{word})\\b"
    group = lambda i: f"regexp_extract_all(spaced, '(?i){place}', {i})"
    return f"""
{out}0 AS (SELECT *, rtrim(regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g'), '.') AS bare, coalesce(question, '') AS q, coalesce(evidence, '') AS e FROM {source}),
{out}1 AS (SELECT *, regexp_replace(e, '([^0-9,.A-Za-z_+-])', '\\1\\1', 'g') AS spaced, try_cast(CASE WHEN regexp_matches(bare, '^{number}$') THEN replace(bare, ',', '') END AS DECIMAL(38,10)) AS wanted FROM {out}0),
{out}2 AS (SELECT *, list_distinct(list_transform(list_filter(list_zip({group(2)}, {group(1)}, {group(3)}), lambda z: try_cast(replace(z[1], ',', '') AS DECIMAL(38,10)) = wanted), lambda z: [z[2], CASE WHEN regexp_matches(z[3], '%|[a-zA-Z]') THEN lower(regexp_replace(trim(z[3]), '\\s+', ' ', 'g')) ELSE '' END])) AS kinds FROM {out}1),
{out}3 AS (SELECT *, CASE WHEN len(kinds) = 1 THEN kinds[1] ELSE ['', ''] END AS beside FROM {out}2),
{out}4 AS (SELECT *, [CASE WHEN regexp_matches(q, '(?i)\\bbasis points?\\b') THEN 'basis points' WHEN regexp_matches(q, '(?i)\\b(?:percent|percentage)\\b') THEN '%' END, lower(regexp_extract(q, '(?i)\\b(thousand|million|billion)\\b', 1)), beside[2]] AS said,
  CASE WHEN regexp_matches(q, '(?i)\\b(?:dollars?|usd)\\b') THEN '$' WHEN beside[1] <> '' THEN beside[1] WHEN contains(e, '$') AND regexp_matches(coalesce(program, ''), '(?i)^\\s*(?:add|subtract)\\s*\\(') THEN '$' ELSE '' END AS sign FROM {out}3),
{out}5 AS (SELECT *, {_unique('said')} AS behind, [CASE WHEN contains(bare, '$') THEN '$' END, CASE WHEN contains(bare, '€') THEN '€' END, CASE WHEN contains(bare, '£') THEN '£' END, CASE WHEN contains(bare, '%') THEN '%' END] || list_transform(regexp_extract_all(bare, '(?i)\\b(?:{word})\\b'), lambda x: lower(x)) AS labels FROM {out}4),
{out}6 AS (SELECT *, [sign] || behind AS told FROM {out}5),
{out} AS (SELECT *, CASE WHEN regexp_matches(bare, '{explicit}') THEN 'preserved' WHEN NOT regexp_matches(bare, '^[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?$') THEN 'not_applicable' WHEN sign <> '' OR len(behind) > 0 THEN 'inferred' WHEN regexp_matches(e, '{explicit}') THEN 'ambiguous' ELSE 'not_applicable' END AS u_status,
  CASE u_status WHEN 'ambiguous' THEN NULL WHEN 'inferred' THEN sign || bare || coalesce(array_to_string(list_transform(behind, lambda x: CASE WHEN x = '%' THEN x ELSE ' ' || x END), ''), '') ELSE bare END AS u_text,
  CASE u_status WHEN 'preserved' THEN {_unique('labels')} WHEN 'inferred' THEN {_unique('told')} ELSE [] END AS u_units FROM {out}6)"""


_AUGMENTED = """
gold AS (SELECT DISTINCT query_id, element_id FROM facts),
need AS (SELECT query_id, count(*) AS n, count(chunk_id) AS held, list_sort(list_distinct(list(chunk_id) FILTER (chunk_id IS NOT NULL))) AS required FROM gold LEFT JOIN (SELECT element_id, max(chunk_id) AS chunk_id FROM lineage GROUP BY element_id) USING (element_id) GROUP BY query_id HAVING count(*) = count(chunk_id) AND count(*) <= 5),
lists AS (SELECT n.query_id, required, coalesce(ranked, []) AS ranked FROM need n LEFT JOIN (SELECT query_id, list(chunk_id ORDER BY rank) AS ranked FROM rk WHERE rank <= 5 GROUP BY query_id) r ON n.query_id = r.query_id),
missing AS (SELECT *, list_filter(required, lambda c: NOT list_contains(ranked, c)) AS absent, list_reverse(list_filter(ranked, lambda c: NOT list_contains(required, c))) AS spare FROM lists),
kept AS (SELECT *, list_filter(ranked, lambda c: NOT list_contains(spare[:greatest(0, len(ranked) + len(absent) - 5)], c)) AS stay FROM missing),
filled AS (SELECT query_id, absent, list_reduce([stay] || list_transform(absent, lambda c: [c]), lambda acc, c: CASE WHEN TRUE THEN
  acc[:(('0x' || substr(sha256(unhex('000000000000000f') || encode('oracle-position') || unhex(printf('%016x', strlen(query_id::VARCHAR))) || encode(query_id::VARCHAR) || unhex(printf('%016x', strlen(c[1]))) || encode(c[1])), 1, 24))::HUGEINT % (len(acc) + 1))::INT] || c ||
  acc[(('0x' || substr(sha256(unhex('000000000000000f') || encode('oracle-position') || unhex(printf('%016x', strlen(query_id::VARCHAR))) || encode(query_id::VARCHAR) || unhex(printf('%016x', strlen(c[1]))) || encode(c[1])), 1, 24))::HUGEINT % (len(acc) + 1))::INT + 1:] END) AS chunks FROM kept),
aug AS (SELECT query_id, unnest(range(1, len(chunks) + 1))::INT AS rank, unnest(chunks) AS chunk_id, absent FROM filled),
augmented AS (SELECT query_id, rank, chunk_id, list_contains(absent, chunk_id) AS injected FROM aug)"""


_CHECKS = ("overall", "content", "refusal", "numeric", "units", "citations")

SQL: dict[str, str] = {
    "char_windows": f"SELECT doc_id, chunk_index, char_start, char_end, md5(piece) AS text_md5 FROM ({_WINDOWS})",
    "lexical_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS term FROM documents) GROUP BY term",
    "query_normalize": _with(_EX) + f"SELECT query_id, array_to_string({_query_tokens('query_text')}, ' ') AS tokens FROM ex",
    "token_counts": _with(_U) + r"SELECT chunk_id, coalesce(len(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\s\pZ\x0b\x85]')), 0) AS n_tokens, length(text) AS n_chars FROM u",
    "content_ids": _with(_U) + "SELECT chunk_id, substr(sha256(document_id || chr(0) || page_start || chr(0) || chunk_index || chr(0) || text), 1, 24) AS digest FROM u WHERE text IS NOT NULL",
    "bm25_statistics": _with(_U, f"tok AS (SELECT document_id, chunk_id, unnest({_tokens('text')}) AS term FROM u)")
    + "SELECT document_id, count(DISTINCT chunk_id) AS n_units, round(count(*) / count(DISTINCT chunk_id), 6) AS avg_length, count(DISTINCT term) AS n_terms FROM tok GROUP BY document_id",
    "bm25_okapi_topk": _with(_U, _EX, _bm25()) + "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM rk",
    "bm25_plus_topk": _with(_U, _EX, _bm25(variant="plus", normalized=True)) + "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM rk",
    "l2_normalize": "SELECT vec_id, round(sum(x / norm), 6) AS total, round(max(x / norm), 6) AS largest FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS norm FROM embeddings) GROUP BY vec_id",
    "dense_cosine_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, round(score, 6) AS score
FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_dot_product(q.e, c.e) AS score FROM n q JOIN n c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
QUALIFY rank <= 5""",
    "dense_scoped_topk": _with(_U, _EX, _dense()) + "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM dk",
    "rrf_fusion": _with(_U, _EX, _bm25(20), _dense(20))
    + """SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank, round(s, 6) AS score, bm25_rank, dense_rank
FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS bm25_rank, b.rank AS dense_rank, coalesce(1e0 / (60 + a.rank), 0e0) + coalesce(1e0 / (60 + b.rank), 0e0) AS s
      FROM rk a FULL JOIN dk b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)
QUALIFY rank <= 5""",
    "parent_diverse_topk": _with(_U, _EX, _bm25(20))
    + f""", kept AS (SELECT query_id, chunk_id, rank, retrieval_unit_kind, row_number() OVER (PARTITION BY query_id, {_PARENT}, retrieval_unit_kind = 'table_row' ORDER BY rank) AS turn FROM rk JOIN u USING (chunk_id))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM kept WHERE retrieval_unit_kind IS DISTINCT FROM 'table_row' OR turn <= 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY kept.rank) <= 5""",
    "hybrid_search": _with(_U, _EX, _bm25(20, "plus", True), _dense(20))
    + f""", fused AS (SELECT query_id, chunk_id, s, bm25_rank, dense_rank, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS bm25_rank, b.rank AS dense_rank, coalesce(1e0 / (60 + a.rank), 0e0) + coalesce(1e0 / (60 + b.rank), 0e0) AS s
  FROM rk a FULL JOIN dk b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id) QUALIFY r <= 20),
kept AS (SELECT f.*, retrieval_unit_kind, row_number() OVER (PARTITION BY query_id, {_PARENT}, retrieval_unit_kind = 'table_row' ORDER BY r) AS turn FROM fused f JOIN u USING (chunk_id))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, round(s, 6) AS score, bm25_rank, dense_rank FROM kept WHERE retrieval_unit_kind IS DISTINCT FROM 'table_row' OR turn <= 2 QUALIFY rank <= 5""",
    "ranking_validity": _with(_U, _EX, _FACTS, _LINEAGE, _bm25(20))
    + """SELECT query_id, count(*) AS n, max(rank)::INT AS last, min(rank)::INT AS first, count(DISTINCT rank) AS ranks, count(DISTINCT chunk_id) AS chunks FROM rk
WHERE (query_id, chunk_id) NOT IN (SELECT (facts.query_id, lineage.chunk_id) FROM facts JOIN lineage USING (element_id)) GROUP BY query_id HAVING count(*) <> max(rank) OR min(rank) <> 1 OR count(*) <> count(DISTINCT rank) OR count(*) <> count(DISTINCT chunk_id)""",
    "retrieval_per_query": _with(_U, _EX, _FACTS, _LINEAGE, _bm25(), _evaluated("rk", "ev")) + "SELECT query_id, first_relevant_rank, n_gold, " + ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS[:-1]) + " FROM ev",
    "retrieval_metrics": _with(_U, _EX, _FACTS, _LINEAGE, _bm25(), _evaluated("rk", "ev"), _rolled("ev", "m")) + "SELECT scope, n_queries, " + ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS) + " FROM m",
    "metric_deltas": _with(_U, _EX, _FACTS, _LINEAGE, _bm25(), _dense(), _evaluated("rk", "ea"), _evaluated("dk", "eb"), _rolled("ea", "ma"), _rolled("eb", "mb"))
    + " UNION ALL ".join(f"SELECT ma.scope, '{c}' AS metric, round(ma.{c}, 6) AS baseline, round(mb.{c}, 6) AS candidate, round(mb.{c} - ma.{c}, 6) AS delta FROM ma JOIN mb USING (scope)" for c in _METRICS),
    "input_counts": _with(_U, _EX)
    + """, d AS (SELECT DISTINCT document_id, metadata['dataset'] AS dataset FROM source_documents WHERE metadata['dataset'] IS NOT NULL),
c AS (SELECT dataset, 1 AS documents, 0 AS units, 0 AS queries FROM d UNION ALL SELECT split_part(document_id, ':', 1), 0, 1, 0 FROM u UNION ALL SELECT dataset, 0, 0, 1 FROM ex)
SELECT CASE WHEN grouping(dataset) = 1 THEN 'combined' ELSE dataset END AS scope, sum(documents)::BIGINT AS documents, sum(units)::BIGINT AS units, sum(queries)::BIGINT AS queries FROM c GROUP BY GROUPING SETS ((dataset), ())""",
    "table_row_units": _ORDER_ROWS,
    "pipe_row_units": _ORDER_ROWS,
    "narrative_units": "SELECT DISTINCT o_orderkey::VARCHAR AS document_id, '# Order ' || o_orderkey || chr(10) || chr(10) || 'Placed with priority ' || o_orderpriority || '.' AS text FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "parent_lookup": _with(_U) + "SELECT a.chunk_id, nullif(trim(a.parent_chunk_id, ' '), '') AS parent_chunk_id, md5(b.text) AS parent_md5 FROM u a LEFT JOIN u b ON nullif(trim(a.parent_chunk_id, ' '), '') = b.chunk_id",
    "qa_link_status": _with(_EX, _RE, _LINKED) + "SELECT record_id, link_status, CASE WHEN link_status IN ('exact', 'equivalent') THEN id END AS linked_id FROM linked",
    "evidence_match": _with(_U, _EX, _EL, _FACTS)
    + f""", f AS (SELECT DISTINCT query_id || '#' || element_id AS fact_id, facts.document_id, {_NORM.format('source_text')} AS e FROM facts JOIN (SELECT element_id, source_text FROM el) USING (element_id)),
t AS (SELECT document_id, chunk_id, chunk_index, {_NORM.format('text')} AS t FROM u),
s AS (SELECT fact_id, chunk_id, chunk_index, CASE WHEN contains(t, e) THEN 1.0e0 ELSE len(list_filter(ew, lambda w: list_contains(tw, w))) / len(ew) END AS score
      FROM (SELECT *, {_EVIDENCE_TOKENS.format('e')} AS ew FROM f) JOIN (SELECT *, {_EVIDENCE_TOKENS.format('t')} AS tw FROM t) USING (document_id) WHERE len(ew) > 0)
SELECT fact_id, chunk_id, chunk_index, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY s.score DESC, chunk_index, chunk_id) = 1 AND s.score >= 0.6""",
    "gold_lineage_map": _with(_U, _EX, _EL, _FACTS, _LINEAGE)
    + f""", f AS (SELECT DISTINCT query_id || '#' || element_id AS fact_id, document_id, element_id FROM facts),
direct AS (SELECT fact_id, chunk_id FROM f JOIN lineage USING (document_id, element_id)),
above AS (SELECT DISTINCT f.fact_id, l.chunk_id FROM f JOIN el ON el.element_id = f.element_id JOIN lineage l ON l.document_id = f.document_id AND l.element_id = el.parent_element_id JOIN u ON u.chunk_id = l.chunk_id
          WHERE f.fact_id NOT IN (SELECT fact_id FROM direct) AND {_ROW.format('el.source_text')} <> '' AND contains({_ROW.format('u.text')}, {_ROW.format('el.source_text')}))
SELECT fact_id, chunk_id, 'lineage' AS via FROM direct UNION SELECT fact_id, chunk_id, 'parent' FROM above
UNION SELECT fact_id, NULL, 'unmapped' FROM f WHERE fact_id NOT IN (SELECT fact_id FROM direct UNION ALL SELECT fact_id FROM above)""",
    "gold_context": _with(_EX, _EL, _FACTS)
    + """SELECT query_id, md5(string_agg('[' || source_key || ']' || chr(10) || source_text, chr(10) || chr(10) ORDER BY position)) AS context_md5
FROM (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY query_id, element_id ORDER BY position) = 1) JOIN (SELECT element_id, source_text FROM el) USING (element_id) GROUP BY query_id""",
    "gold_removed_topk": _with(_U, _EX, _FACTS, _LINEAGE, _bm25(20))
    + "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rk.rank, chunk_id) AS rank FROM rk WHERE (query_id, chunk_id) NOT IN (SELECT (facts.query_id, lineage.chunk_id) FROM facts JOIN lineage USING (element_id)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rk.rank, chunk_id) <= 5",
    "gold_sufficiency": _with(_U, _EX, _FACTS, _LINEAGE, _bm25())
    + """SELECT g.query_id, count(*) AS n_gold, count(h.element_id) AS n_found, count(*) = count(h.element_id) AS sufficient
FROM (SELECT DISTINCT query_id, element_id FROM facts) g LEFT JOIN (SELECT DISTINCT query_id, element_id FROM rk JOIN lineage USING (chunk_id)) h ON g.query_id = h.query_id AND g.element_id = h.element_id GROUP BY g.query_id""",
    "sample_by_hash": _with(_EX) + "SELECT query_id, example_id FROM ex ORDER BY sha256('evidence-sample' || chr(0) || query_id), query_id::VARCHAR LIMIT 128",
    "sample_per_split": "SELECT document_id, split FROM (SELECT DISTINCT document_id, metadata['split'] AS split FROM source_documents WHERE metadata['split'] IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha256(document_id), document_id) <= 5",
    "split_80_10_10": _with(_RE, "named AS (SELECT record_no, source_file, document_id FROM re WHERE document_id IS NOT NULL)", _GROUPED.format("named")) + f"SELECT record_no, group_id, {_ASSIGNED} AS split FROM g",
    "refusal_sample": _with(_RE)
    + """, w AS (SELECT dataset, source_split, round_even(count(*) * 0.2::DOUBLE / (1 - 0.2::DOUBLE), 0)::BIGINT AS wanted FROM re WHERE answerable GROUP BY ALL),
t AS (SELECT record_no::VARCHAR AS example_id, dataset, source_split, row_number() OVER (PARTITION BY dataset, source_split ORDER BY sha256(unhex(printf('%016x', strlen(record_no::VARCHAR))) || encode(record_no::VARCHAR))[:24], record_no::VARCHAR) AS turn FROM re WHERE NOT answerable)
SELECT example_id, dataset, source_split FROM t JOIN w USING (dataset, source_split) WHERE turn <= wanted""",
    "entity_conflicts": "SELECT document_id, count(*) AS n_rows, count(DISTINCT (coalesce(title, chr(0)), coalesce(checksum_sha256, chr(0)), coalesce(metadata['split'], chr(0)), coalesce(deleted_at::VARCHAR, chr(0)))) AS n_contents FROM source_documents WHERE document_id IS NOT NULL GROUP BY document_id HAVING n_contents > 1",
    "fk_violations": """
WITH f AS (SELECT record_no, question.document_id AS d, unnest(supporting_facts).element_id AS e FROM examples)
SELECT DISTINCT 'element without document' AS check_name, element_id AS row_key, document_id AS ref_key FROM elements WHERE document_id NOT IN (SELECT document_id FROM source_documents WHERE document_id IS NOT NULL)
UNION SELECT 'element without parent', element_id, parent_element_id FROM elements WHERE parent_element_id NOT IN (SELECT element_id FROM elements WHERE element_id IS NOT NULL)
UNION SELECT 'example without document', record_no::VARCHAR, d FROM f WHERE d NOT IN (SELECT document_id FROM source_documents WHERE document_id IS NOT NULL)
UNION SELECT 'fact without element', record_no::VARCHAR, e FROM f WHERE e NOT IN (SELECT element_id FROM elements WHERE element_id IS NOT NULL)""",
    "split_overlap": _with(_RE)
    + ", s AS (SELECT DISTINCT document_id, lower(trim(split)) AS split FROM re WHERE document_id IS NOT NULL AND split IS NOT NULL) SELECT document_id, a.split AS left_split, b.split AS right_split FROM s a JOIN s b USING (document_id) WHERE a.split < b.split",
    "offset_violations": f"""SELECT doc_id, chunk_index, CASE WHEN length(piece) <> char_end - char_start THEN 'length' ELSE 'text' END AS reason FROM ({_WINDOWS}) JOIN (SELECT doc_id, trim(text, ' ') AS whole FROM documents) USING (doc_id)
WHERE length(piece) <> char_end - char_start OR piece <> substr(whole, char_start + 1, char_end - char_start)""",
    "preparation_statistics": _with(_EX, _RE, _LINKED)
    + """SELECT dataset AS split, count(*) AS total, count(CASE WHEN link_status IN ('exact', 'equivalent') THEN 1 END) AS normalized, 0::BIGINT AS unlinked, count(CASE WHEN link_status = 'ambiguous' THEN 1 END) AS ambiguous,
count(CASE WHEN link_status = 'answer_mismatch' THEN 1 END) AS answer_mismatch, 0::BIGINT AS evidence_incomplete, 0::BIGINT AS duplicates, count(*) - count(CASE WHEN link_status IN ('exact', 'equivalent') THEN 1 END) AS skipped FROM linked GROUP BY dataset""",
    "export_histograms": _with(_RE)
    + " UNION ALL ".join(f"SELECT {f}::VARCHAR AS value, count(*) AS n, '{f}' AS field FROM re GROUP BY ALL" for f in ("category", "context_mode", "unit_status", "answerable"))
    + " UNION ALL SELECT value, count(*) AS n, 'expected_units' AS field FROM (SELECT unnest(expected_units) AS value FROM re) GROUP BY ALL",
    "table_fingerprint": _with(_U, "h AS (SELECT sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END" for c in ("chunk_id", "document_id", "text")) + ")) AS h FROM u)")
    + "SELECT count(*) AS n_rows, concat_ws('-', " + ", ".join(f"sum(('0x' || substr(h, {i}, 15))::HUGEINT)::VARCHAR" for i in (1, 16, 31, 46)) + ") AS digest FROM h",
    "grounded_prompts": _with(_U, _EX, _bm25(3))
    + f""", c AS (SELECT query_id, count(*) AS n, string_agg('[Source ' || rank || ' | page ' || coalesce({_PAGE}, '?') || ' | chunk_id ' || chunk_id || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM rk JOIN u USING (chunk_id) GROUP BY query_id)
SELECT query_id, md5('Retrieved context:' || chr(10) || chr(10) || coalesce(context, '{NO_CONTEXT}') || chr(10) || chr(10) || 'Question:' || chr(10) || trim(query_text, ' ')) AS user_md5, coalesce(n, 0) AS n_sources FROM ex LEFT JOIN c USING (query_id)""",
    "citations": _with(_U, _EX, _bm25(3)) + f"SELECT query_id, rank AS source_number, chunk_id, {_PAGE} AS page_label FROM rk JOIN u USING (chunk_id)",
    "answer_assessment": _with(_RE, _answered()) + f"SELECT record_no, {', '.join(_CHECKS)} FROM scored",
    "answer_metrics": _with(_RE, _answered())
    + "SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(context_mode) = 0 THEN 'context_mode' ELSE 'all' END AS scope, CASE WHEN grouping(category) = 0 THEN category WHEN grouping(context_mode) = 0 THEN context_mode ELSE 'all' END AS value, "
    + ", ".join(f"count(CASE WHEN {c} THEN 1 END) AS {c}_correct, count({c}) AS {c}_count" for c in _CHECKS)
    + " FROM scored GROUP BY GROUPING SETS ((category), (context_mode), ())",
    "answer_differences": _with(_RE, _answered(), _answered("TRUE", "2"), *[f"rolled{n} AS (SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(context_mode) = 0 THEN 'context_mode' ELSE 'all' END AS scope, CASE WHEN grouping(category) = 0 THEN category WHEN grouping(context_mode) = 0 THEN context_mode ELSE 'all' END AS value, " + ", ".join(f"count(CASE WHEN {c} THEN 1 END) / nullif(count({c}), 0) AS {c}" for c in _CHECKS) + f" FROM scored{n} GROUP BY GROUPING SETS ((category), (context_mode), ()))" for n in ("", "2")])
    + " UNION ALL ".join(f"SELECT a.scope, a.value, '{c}' AS check_name, round(a.{c}, 6) AS base, round(b.{c}, 6) AS other, round(b.{c} - a.{c}, 6) AS delta FROM rolled a JOIN rolled2 b USING (scope, value)" for c in _CHECKS),
    "budget_trim": _with(_U, _EX, _FACTS, _LINEAGE, _bm25())
    + """, g AS (SELECT DISTINCT facts.query_id, lineage.chunk_id FROM facts JOIN lineage USING (element_id)),
c AS (SELECT rk.query_id, rk.chunk_id, rk.rank, len(regexp_extract_all(u.text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s\\pZ\\x0b\\x85]')) AS n, g.chunk_id IS NOT NULL AS is_gold FROM rk JOIN u USING (chunk_id) LEFT JOIN g ON g.query_id = rk.query_id AND g.chunk_id = rk.chunk_id),
w AS (SELECT *, sum(CASE WHEN is_gold THEN n ELSE 0 END) OVER (PARTITION BY query_id) AS gold, sum(CASE WHEN is_gold THEN 0 ELSE n END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS others FROM c)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY w.rank) AS rank, is_gold, gold > 600 AS overflow FROM w WHERE is_gold OR gold + others <= 600""",
    "unit_rules": _with(_U)
    + """, r AS (SELECT chunk_id AS row_key, unnest([
  CASE WHEN coalesce(trim(text, ' '), '') = '' THEN 'text is blank' END, CASE WHEN text IS NOT NULL AND char_count IS DISTINCT FROM length(text) THEN 'char_count differs' END,
  CASE WHEN text IS NOT NULL AND token_count IS DISTINCT FROM len(regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s\\pZ\\x0b\\x85]')) THEN 'token_count differs' END, CASE WHEN page_start > page_end THEN 'pages out of order' END,
  CASE WHEN page_start < 1 THEN 'page is below 1' END, CASE WHEN chunk_index < 0 THEN 'chunk_index is negative' END, CASE WHEN len(source_element_ids) < 1 THEN 'no source element' END,
  CASE WHEN retrieval_unit_kind IS NULL OR retrieval_unit_kind NOT IN ('chunk', 'narrative', 'table_row') THEN 'unknown kind' END,
  CASE WHEN NOT (retrieval_unit_kind IN ('narrative', 'table_row') OR coalesce(trim(parent_chunk_id, ' '), '') = '') THEN 'a chunk has no parent' END]) AS rule FROM u)
SELECT row_key, rule FROM r WHERE rule IS NOT NULL""",
    "element_rules": _with(_EL)
    + """, r AS (SELECT element_id AS row_key, unnest([
  CASE WHEN coalesce(trim(document_id, ' '), '') = '' THEN 'document_id is blank' END, CASE WHEN element_type IS NULL OR element_type NOT IN ('heading', 'paragraph', 'table', 'table_row', 'caption', 'footnote') THEN 'unknown element_type' END,
  CASE WHEN page_number < 1 THEN 'page_number is below 1' END, CASE WHEN (element_type IN ('table', 'table_row')) <> (table_coordinates IS NOT NULL) THEN 'coordinates only for tables and rows' END,
  CASE WHEN table_coordinates IS NOT NULL AND coalesce(trim(table_coordinates.table_id, ' '), '') = '' THEN 'table_id is blank' END,
  CASE WHEN table_coordinates.row_index < 0 THEN 'row_index is negative' END, CASE WHEN table_coordinates.column_index < 0 THEN 'column_index is negative' END,
  CASE WHEN coalesce(table_coordinates.row_span, 1) < 1 OR coalesce(table_coordinates.column_span, 1) < 1 THEN 'span is below 1' END]) AS rule FROM el)
SELECT row_key, rule FROM r WHERE rule IS NOT NULL""",
    "benchmark_units": _with(_EL)
    + """, kids AS (SELECT parent_element_id AS element_id, list(element_id ORDER BY r, element_id) AS child_ids FROM (SELECT DISTINCT parent_element_id, element_id, coalesce(table_coordinates.row_index, -1) AS r FROM el WHERE parent_element_id IS NOT NULL) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number NULLS FIRST, element_id) - 1 AS chunk_index FROM el WHERE parent_element_id IS NULL AND regexp_matches(source_text, '[\\pL\\pN$€£¥%]'))
SELECT 'normalized-chunk:' || sha256(""" + _framed("document_id", "element_id", "coalesce(source_text, '')") + """) AS chunk_id, document_id, chunk_index::INT AS chunk_index, [element_id] || coalesce(child_ids, []) AS source_element_ids FROM top LEFT JOIN kids USING (element_id)""",
    "training_units": _with(_EL)
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number NULLS FIRST, element_id) - 1 AS chunk_index FROM el)
SELECT 'chunk:' || substr(sha256(""" + _framed("document_id", "element_id", "source_text") + """), 1, 24) AS chunk_id, document_id, chunk_index::INT AS chunk_index, [element_id] AS source_element_ids FROM numbered
WHERE regexp_matches(source_text, '[\\pL\\pN$€£¥%]') AND element_id NOT IN (SELECT parent_element_id FROM el WHERE element_type = 'table_row' AND parent_element_id IS NOT NULL)""",
    "refusal_guard": _with(_U, _EX, _bm25(3), _GUARD) + f"SELECT query_id, {_gives_away('context', 'answer')} AS given_away FROM shown JOIN (SELECT query_id, answer FROM ex WHERE answer IS NOT NULL) USING (query_id)",
    "plain_chat_records": _with(_EX, _EL, _FACTS)
    + f""", c AS (SELECT query_id, string_agg('[' || source_key || ']' || chr(10) || source_text, chr(10) || chr(10) ORDER BY position) AS context
FROM (SELECT * FROM facts WHERE element_id IN (SELECT element_id FROM el) QUALIFY row_number() OVER (PARTITION BY query_id, element_id ORDER BY position) = 1) JOIN (SELECT element_id, source_text FROM el) USING (element_id) GROUP BY query_id)
SELECT query_id, dataset, split, md5('system:{INSTRUCTION}|user:Context:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || trim(query_text, ' ') || '|assistant:' || trim(answer, ' ')) AS messages_md5
FROM ex JOIN c USING (query_id) WHERE coalesce(trim(answer, ' '), '') <> '' AND coalesce(trim(query_text, ' '), '') <> '' AND context IS NOT NULL""",
    "refusal_records": _with(_U, _EX, _FACTS, _LINEAGE, _bm25(20))
    + f""", asked AS (SELECT query_id, dataset, split AS source_split, document_id, source_file, query_text AS question, answer FROM ex WHERE answer IS NOT NULL AND trim(query_text, ' ') <> ''),
g AS (SELECT DISTINCT query_id, element_id FROM facts),
ok AS (SELECT g.query_id, count(*) = count(h.element_id) AND count(*) <= 5 AS enough FROM g LEFT JOIN (SELECT DISTINCT query_id, element_id FROM rk JOIN lineage USING (chunk_id) WHERE rank <= 5) h ON g.query_id = h.query_id AND g.element_id = h.element_id GROUP BY g.query_id),
hidden AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rk.rank, chunk_id) AS rank FROM rk JOIN ok USING (query_id) WHERE enough AND (query_id, chunk_id) NOT IN (SELECT (g.query_id, lineage.chunk_id) FROM g JOIN lineage USING (element_id)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rk.rank, chunk_id) <= 5),
ctx AS (SELECT query_id, chunk_id, rank FROM rk JOIN ok USING (query_id) WHERE NOT enough AND rank <= 5 UNION ALL SELECT * FROM hidden),
it AS (SELECT query_id, chunk_id, rank, coalesce(text, '') AS text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, '[Source ' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || ' | page ' || coalesce({_PAGE}, '?') || ' | chunk_id ' || chunk_id || ']' || chr(10) || coalesce(text, '') AS item FROM ctx JOIN u USING (chunk_id)),
safe AS (SELECT a.* FROM asked a JOIN (SELECT query_id, string_agg(text, chr(10) ORDER BY n) AS context FROM it GROUP BY query_id) c USING (query_id) WHERE NOT {_gives_away('c.context', 'a.answer')}),
fit AS (SELECT query_id, chunk_id, n, item, count(*) OVER (PARTITION BY query_id) AS total FROM (SELECT it.*, sum({_count('item')}) OVER (PARTITION BY query_id ORDER BY n) AS cost FROM it) JOIN safe USING (query_id)
  WHERE cost <= 4096 - {_count(f"'{INSTRUCTION}'")} - {_count("'Retrieved context: Question: ' || trim(question, ' ')")} - {_count(f"'{UNSUPPORTED}'")}),
made AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY n) AS chunks, string_agg(item, chr(10) || chr(10) ORDER BY n) AS context, count(*) AS kept FROM fit GROUP BY query_id),
rec AS (SELECT s.*, chunks, kept, (SELECT count(*) FROM it WHERE it.query_id = s.query_id) AS total, 'Retrieved context:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || trim(question, ' ') AS said FROM safe s JOIN made USING (query_id)),
{_GROUPED.format('rec').strip()}
SELECT query_id, dataset, source_split, {_ASSIGNED} AS split, group_id AS document_group_id, document_id, FALSE AS answerable, 'unsupported' AS category, 'retrieval_insufficient' AS context_mode, FALSE AS calculation_supervised, 'not_applicable' AS unit_status, NULL::VARCHAR AS reasoning_program,
  kept < total AS context_trimmed, ({_count(f"'{INSTRUCTION}'")} + {_count('said')} + {_count(f"'{UNSUPPORTED}'")})::INT AS sequence_token_count, '' AS expected_values, '' AS expected_units, '' AS gold_source_element_ids, '' AS gold_source_numbers, chunks AS source_chunk_ids, '' AS oracle_injected_chunk_ids, '' AS oracle_injected_source_numbers,
  md5('system:{INSTRUCTION}|user:' || said || '|assistant:{UNSUPPORTED}') AS messages_md5 FROM g""".replace("\ng AS (SELECT DISTINCT query_id, element_id FROM facts)", "\nwanted AS (SELECT DISTINCT query_id, element_id FROM facts)").replace("FROM g LEFT JOIN (SELECT DISTINCT", "FROM wanted g LEFT JOIN (SELECT DISTINCT").replace("FROM g JOIN lineage", "FROM wanted g JOIN lineage"),
    "oracle_augment": _with(_U, _EX, _FACTS, _LINEAGE, _bm25(), _AUGMENTED.strip()) + "SELECT query_id, rank, chunk_id, injected FROM augmented",
    "unit_inference": _with(
        _U, _EX, _EL, _FACTS, "ev AS (SELECT query_id, string_agg(source_text, chr(10) ORDER BY position, source_text) AS evidence FROM (SELECT DISTINCT query_id, position, source_text FROM facts JOIN (SELECT element_id, source_text FROM el) USING (element_id)) GROUP BY query_id)",
        "asked AS (SELECT query_id, answer, query_text AS question, evidence, program FROM ex LEFT JOIN ev USING (query_id))", _unit_steps("asked", "un").strip(),
    ) + "SELECT query_id, u_text AS answer_text, u_units AS answer_units, u_status AS unit_status FROM un",
    "training_records": _with(_U, _EX, _FACTS, _LINEAGE, _bm25(), _AUGMENTED.strip())
    + f""", touching AS (SELECT DISTINCT query_id, chunk_id FROM gold JOIN lineage USING (element_id)),
it AS (SELECT a.query_id, a.rank, a.chunk_id, a.injected, t.chunk_id IS NOT NULL AS is_gold, u.text, u.retrieval_unit_kind AS kind, {_PAGE} AS page,
  {_count("'[Source 1 | page ' || coalesce(" + _PAGE + ", '?') || ' | chunk_id ' || a.chunk_id || ']' || chr(10) || coalesce(u.text, '')")} AS cost
  FROM augmented a JOIN u ON u.chunk_id = a.chunk_id LEFT JOIN touching t ON t.query_id = a.query_id AND t.chunk_id = a.chunk_id),
per AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) FILTER (is_gold) AS evidence, coalesce(sum(cost) FILTER (is_gold), 0) AS gold_cost, count(*) FILTER (is_gold) AS n_gold, count(*) AS total FROM it GROUP BY query_id),
ids AS (SELECT query_id, list_sort(list(element_id)) AS gold_ids FROM gold GROUP BY query_id),
asked AS (SELECT x.query_id, dataset, split AS source_split, document_id, source_file, query_text AS question, answer, explanation, program AS raw_program, n_steps, evidence, gold_cost, n_gold, total, gold_ids,
  nullif(array_to_string(list_filter(list_transform(string_split_regex(CASE WHEN coalesce(normalized_program, '') <> '' THEN normalized_program ELSE program END, '\\r\\n|\\r|\\n'), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), chr(10)), '') AS program
  FROM ex x JOIN per USING (query_id) JOIN ids USING (query_id) WHERE n_gold > 0 AND answer IS NOT NULL AND trim(query_text, ' ') <> ''),
{_unit_steps('asked', 'un').strip()},
told AS (SELECT *, regexp_replace(nullif(regexp_replace(explanation, '^\\s+|\\s+$', '', 'g'), ''), '\\.+$', '') AS why FROM un WHERE u_status <> 'ambiguous'),
spoken AS (SELECT *, CASE WHEN program IS NOT NULL THEN 'Calculation:' || chr(10) || program || chr(10) || 'The answer is ' || u_text WHEN why IS NULL THEN 'The answer is ' || u_text WHEN contains(replace(lower(why), 'ß', 'ss'), replace(lower(u_text), 'ß', 'ss')) THEN why ELSE why || '. The answer is ' || u_text END AS sentence FROM told),
roomy AS (SELECT *, 4096 - {_count(f"'{INSTRUCTION}'")} - {_count("'Retrieved context: Question: ' || trim(question, ' ')")} - gold_cost - {_count("sentence || '. '")} - 4 * n_gold AS room FROM spoken),
run AS (SELECT it.*, room, sum(CASE WHEN is_gold THEN 0 ELSE cost END) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM it JOIN (SELECT query_id, room FROM roomy WHERE room >= 0) USING (query_id)),
stays AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM run WHERE is_gold OR spent <= room),
made AS (SELECT query_id, count(*) AS kept, bool_or(injected) AS oracle, bool_or(is_gold AND coalesce(kind, '') = 'table_row') AS tabular, string_agg(chunk_id, ',' ORDER BY n) AS chunks, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (is_gold), '') AS gold_numbers,
  coalesce(string_agg(chunk_id, ',' ORDER BY n) FILTER (injected), '') AS put, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (injected), '') AS put_numbers, string_agg('[Source ' || n || ']', ' ' ORDER BY n) FILTER (is_gold) AS cited,
  string_agg('[Source ' || n || ' | page ' || coalesce(page, '?') || ' | chunk_id ' || chunk_id || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY n) AS context FROM stays GROUP BY query_id),
rec AS (SELECT r.*, m.* EXCLUDE (query_id), 'Retrieved context:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || trim(question, ' ') AS asks, sentence || '. ' || cited AS says FROM roomy r JOIN made m USING (query_id)),
{_GROUPED.format('rec').strip()}
SELECT query_id, dataset, source_split, {_ASSIGNED} AS split, group_id AS document_group_id, document_id, TRUE AS answerable, CASE WHEN coalesce(raw_program, '') <> '' OR coalesce(n_steps, 0) > 0 THEN 'reasoning' WHEN tabular THEN 'table_lookup' ELSE 'simple_lookup' END AS category,
  CASE WHEN oracle THEN 'oracle_augmented' ELSE 'retrieved' END AS context_mode, program IS NOT NULL AS calculation_supervised, u_status AS unit_status, program AS reasoning_program, kept < total AS context_trimmed,
  ({_count(f"'{INSTRUCTION}'")} + {_count('asks')} + {_count('says')})::INT AS sequence_token_count, answer AS expected_values, coalesce(array_to_string(u_units, ','), '') AS expected_units, array_to_string(gold_ids, ',') AS gold_source_element_ids, gold_numbers AS gold_source_numbers,
  chunks AS source_chunk_ids, put AS oracle_injected_chunk_ids, put_numbers AS oracle_injected_source_numbers, md5('system:{INSTRUCTION}|user:' || asks || '|assistant:' || says) AS messages_md5 FROM g""",
    "windowed_event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "json_props": "SELECT event_type, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, max(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type",
}
