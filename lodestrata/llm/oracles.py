"""DuckDB SQL of the queries of the subpackage that SQL can express."""

from __future__ import annotations

from lodestrata.llm.names import LEGAL_FORMS, PLACEHOLDERS, SPLIT_NAMES, TITLES


def _squeezed(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[\s]+', ' ', 'g'))"


def _bare(c: str) -> str:
    return rf"trim(regexp_replace({_squeezed(c)}, '[^\pL\pN]+', ' ', 'g'))"


def _plain(c: str) -> str:
    return f"CASE WHEN {_bare(c)} = '' OR regexp_matches({_bare(c)}, '{PLACEHOLDERS}') THEN NULL ELSE {_squeezed(c)} END"


_TITLES = ", ".join(f"'{t}'" for t in TITLES)
_PERSON = f"nullif(array_to_string(list_sort(list_filter(string_split(trim(regexp_replace({_plain('author')}, '[^\\pL\\pN]+', ' ', 'g')), ' '), lambda w: w NOT IN ({_TITLES}))), ' '), '')"
_FIRM = f"regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace({_plain('entity')}, '[.''’]', '', 'g'), '[^\\pL\\pN]+', ' ', 'g')), '^the ', ''), '^(.+?)(?: (?:{'|'.join(LEGAL_FORMS)}|and co))+$', '\\1')"
_PATH = f"regexp_replace(regexp_replace(replace({_plain('source_file')}, '\\', '/'), '/+', '/', 'g'), '^(?:\\./)+', '')"
_SPLIT = "CASE " + " ".join(f"WHEN regexp_replace(lower(split), '[\\s_.-]+', '', 'g') IN ({', '.join(repr(x) for x in spellings)}) THEN '{name}'" for name, spellings in SPLIT_NAMES.items()) + " END"

SQL: dict[str, str] = {
    "p2_found": f"""
WITH RECURSIVE re AS (SELECT * FROM rag_export WHERE record_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_no ORDER BY received_at DESC NULLS LAST) = 1),
held AS (
  SELECT record_no AS n, 'd' AS k, {_plain('document_id')} AS v FROM re UNION ALL SELECT record_no, 'g', {_plain('document_group_id')} FROM re
  UNION ALL SELECT record_no, 'a', {_PERSON} FROM re UNION ALL SELECT record_no, 'e', nullif({_FIRM}, '') FROM re
  UNION ALL SELECT record_no, 'r', nullif(regexp_extract({_PATH}, '^(.+)/[^/]*$', 1), '') FROM re),
links AS (SELECT n AS a, min(n) OVER (PARTITION BY k, v) AS b FROM held WHERE v IS NOT NULL),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT record_no AS n, record_no AS m FROM re UNION SELECT r.n, e.b FROM reach r JOIN edges e ON e.a = r.m),
groups AS (SELECT n AS record_no, min(m) AS group_no FROM reach GROUP BY n),
said AS (SELECT g.group_no, count(DISTINCT {_SPLIT}) AS splits FROM groups g JOIN re USING (record_no) GROUP BY g.group_no)
SELECT record_no, group_no FROM groups JOIN said USING (group_no) WHERE splits > 1""",
    "p3_found": r"""
SELECT DISTINCT u.chunk_id
FROM units u
LEFT JOIN chunking_profiles p ON p.profile = u.profile
CROSS JOIN (SELECT max_tokens AS standard FROM chunking_profiles WHERE profile = 'standard')
WHERE len(regexp_extract_all(u.text, '[\pL\pN_]+|[^\pL\pN_\s\pZ\x1c-\x1f\x85]')) > coalesce(p.max_tokens, standard)
""",
}
