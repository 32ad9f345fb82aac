r"""Independent SQL for the queries of the catalog: pieces that their oracles share.

Written for DuckDB, whose patterns know \p{L}, \p{Lu}, \p{Ll} but no look-around.
"""

from __future__ import annotations


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value!r}::DOUBLE" if isinstance(value, float) else repr(value)


def values(rows: list[tuple], names: str) -> str:
    """A subquery of literal rows."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names}))"


def fold(x: str) -> str:
    return f"replace(replace(replace(lower({x}), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ')"


def tf(src: str, keys: str, text: str = "text") -> str:
    """keys, term, tf of the token grammar over ``src``."""
    alnum = r"'[\p{L}\p{N}]'"
    camel = r"regexp_replace(regexp_replace(r, '(\p{Ll})(\p{Lu})', '\1_\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1_\2', 'g')"
    shorter = r"regexp_replace(o, '[-.:/\\]$', '')"
    form = "CASE WHEN strlen(f) > 256 THEN chr(0) || 'long:' || sha256(f) ELSE f END"
    return rf"""(
      WITH occ AS (SELECT {keys}, o, count(*) AS n FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_.:/\\-]+')) AS o FROM {src}) GROUP BY ALL),
      runs AS (SELECT o, generate_subscripts(rs, 1) AS i, unnest(rs) AS r FROM (SELECT o, regexp_split_to_array(o, '[-.:/\\]+') AS rs FROM (SELECT DISTINCT o FROM occ))),
      parts AS (SELECT o, i, unnest(string_split({camel}, '_')) AS c FROM runs WHERE regexp_matches(r, {alnum})),
      forms AS (
        SELECT o, f FROM (SELECT DISTINCT o, i, {fold('c')} AS f FROM parts WHERE regexp_matches(c, {alnum}) UNION SELECT o, i, {fold('r')} FROM runs WHERE regexp_matches(r, {alnum}))
        UNION ALL
        SELECT o, {fold(rf"CASE WHEN regexp_matches({shorter}, '[-.:/\\]') THEN {shorter} ELSE o END")} FROM (SELECT DISTINCT o FROM occ) WHERE regexp_matches(o, '[-.:/\\]') AND regexp_matches(o, {alnum}))
      SELECT {keys}, {form} AS term, CAST(sum(n) AS BIGINT) AS tf FROM occ JOIN forms USING (o) GROUP BY ALL)"""


DOCS = "(SELECT CAST(doc_id AS VARCHAR) AS match_id, source || '/' || doc_id || '.txt' AS path, text FROM documents)"
TALKS = """(SELECT conv_id || ':' || turn AS match_id, 'talks/' || conv_id || '.jsonl' AS path, text, role, CAST(conv_id AS VARCHAR) AS session_id,
  CASE conv_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'copilot' END AS agent,
  strftime(TIMESTAMP '2026-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp FROM conversations)"""


def share(tf_: str = "tf", length: str = "length", n: str = "n", total: str = "total", df: str = "df", weight: str = "weight") -> str:
    idf = f"CAST(ln(1 + ({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE)) AS FLOAT)::DOUBLE"
    sat = f"CAST({tf_} / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {length} / ({total}::DOUBLE / {n})) + {tf_}) AS FLOAT)::DOUBLE"
    return f"CAST(CAST({idf} * {sat} AS FLOAT) * CAST({weight} AS FLOAT) AS FLOAT)::DOUBLE"


def index(src: str) -> str:
    """CTEs post, len, st, df over ``src`` (match_id, text)."""
    return f"""src AS MATERIALIZED (SELECT * FROM {src}), post AS MATERIALIZED {tf('src', 'match_id')},
    len AS (SELECT match_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS length FROM src LEFT JOIN post USING (match_id) GROUP BY 1),
    st AS (SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS total FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"""


def scored(src: str, queries: str, where: str = "TRUE", terms: str | None = None) -> str:
    """CTEs up to ``hits`` (query_id, match_id, score FLOAT) for queries (query_id, query); ``where`` filters chunks, not statistics."""
    q = terms or f"(SELECT query_id, term, tf AS weight FROM {tf(queries, 'query_id', 'query')})"
    return f"""{index(src)}, q AS {q},
    hits AS MATERIALIZED (SELECT query_id, match_id, CAST(sum({share()}) AS FLOAT) AS score FROM post JOIN q USING (term) JOIN df USING (term) JOIN len USING (match_id) CROSS JOIN st
      WHERE match_id IN (SELECT match_id FROM src WHERE {where}) GROUP BY 1, 2)"""


def top(k: int, of: str = "hits", columns: str = "query_id, match_id, CAST(round(score::DOUBLE, 5) AS DOUBLE) AS score") -> str:
    return f"""SELECT {columns}, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score::DOUBLE, 5) DESC, match_id) AS rank FROM {of}) WHERE rank <= {k}"""
