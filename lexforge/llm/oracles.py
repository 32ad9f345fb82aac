"""SQL for what SQL can express of the training-data operators, in DuckDB's dialect."""

from __future__ import annotations

#: Components over ``links`` (a, b), both ways round: a, least.
REACHED = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS least FROM reach GROUP BY a)"""

EMBEDDINGS = f"""
WITH RECURSIVE own AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda c: abs(c))) > 0
),
links AS (
  SELECT DISTINCT p.vec_id AS a, q.vec_id AS b FROM own AS p JOIN own AS q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.9
),
{REACHED},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, COALESCE(n, 0) AS n_links, LEAST(e.vec_id, COALESCE(least, e.vec_id)) AS component_id, e.vec_id <= COALESCE(least, e.vec_id) AS kept
FROM embeddings AS e LEFT JOIN least ON e.vec_id = least.a LEFT JOIN counts ON e.vec_id = counts.a
"""

#: A pair that is similar enough shares one of the rarest shingles of either: 0.2 of a set, and one more.
MINHASH = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
),
rows AS (SELECT doc_id, len(s) AS size, unnest(s) AS shingle FROM sets),
rare AS (
  SELECT doc_id, size, shingle FROM rows JOIN (SELECT shingle, count(*) AS df FROM rows GROUP BY shingle) USING (shingle)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, shingle) <= size - CAST(ceil(0.8 * size) AS BIGINT) + 1
),
pairs AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM rare AS p JOIN rare AS q USING (shingle) WHERE p.doc_id < q.doc_id AND 100 * LEAST(p.size, q.size) >= 80 * GREATEST(p.size, q.size)),
linked AS (
  SELECT a, b FROM pairs JOIN sets AS p ON p.doc_id = a JOIN sets AS q ON q.doc_id = b
  WHERE 100 * len(list_intersect(p.s, q.s)) >= 80 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))
),
links AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
{REACHED}
SELECT doc_id, len(s) AS n_shingles, LEAST(doc_id, COALESCE(least, doc_id)) AS component_id, doc_id <= COALESCE(least, doc_id) AS kept FROM sets LEFT JOIN least ON doc_id = a
"""


def matches(kind: str, pattern: str, group: int = 0) -> str:
    """Columns of a kind's leftmost matches, of a ``group`` of them, and of what stands between them."""
    quoted = pattern.replace("'", "''")
    return f"regexp_extract_all(t, '{quoted}') AS {kind}_m, regexp_extract_all(t, '{quoted}', {group}) AS {kind}_g, string_split_regex(t, '{quoted}') AS {kind}_p"


def spans(kind: str, number: int, keep: str) -> str:
    """A list of (kind, start, label) of the matches that ``keep`` (of {m}, the match's group) lets stay: a match begins after all that stands before it."""
    start = f"CAST(list_sum(list_transform({kind}_p[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform({kind}_m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    each = f"list_transform(list_filter(range(1, len({kind}_m) + 1), lambda i: {keep.replace('{m}', f'{kind}_g[i]')}), lambda i: {{'start': {start}, 'size': length({kind}_m[i])}})"
    return f"list_transform({each}, lambda x: {{'kind': {number}, 'start': x.start, 'label': '{kind}:' || x.start || ':' || (x.start + x.size)}}) AS {kind}"


DIGITS = "regexp_replace({m}, '[^0-9]', '', 'g')"
LUHN = f"""list_sum(list_transform(range(0, length({DIGITS})), lambda k:
  CASE WHEN k % 2 = 0 THEN CAST({DIGITS}[length({DIGITS}) - k] AS INT) ELSE (2 * CAST({DIGITS}[length({DIGITS}) - k] AS INT)) // 10 + (2 * CAST({DIGITS}[length({DIGITS}) - k] AS INT)) % 10 END)) % 10 = 0"""
IP_PARTS = "len(list_filter(string_split({m}, '.'), lambda p: length(ltrim(p, '0')) > 3 OR COALESCE(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0"


def either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


SECRETS = {
    "assign": (rf"""({either_case('password|passwd|secret|token|api_?key')})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length({m}) >= 6"),
    "access": ("AKIA[A-Z0-9]+", 0, "length({m}) >= 20"),
    "hex": ("[0-9a-f]{24,}", 0, "true"),  # a maximal run, as [0-9a-f]+ takes it
}
PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, IP_PARTS),
    "card": (r"[0-9]([\x20-]?[0-9])+", 0, f"length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({DIGITS}) BETWEEN 9 AND 15"),
}


def base_sql(kinds: dict[str, tuple[str, int, str]], listed: str) -> str:
    return f"""
WITH texts AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
parts AS (SELECT doc_id, {', '.join(matches(k, p, g) for k, (p, g, _) in kinds.items())} FROM texts),
found AS (SELECT doc_id, {', '.join(spans(k, n, keep) for n, (k, (_, _, keep)) in enumerate(kinds.items()))} FROM parts)
SELECT doc_id, {', '.join(f'len({k}) AS n_{k}' for k in kinds)}, sha256(COALESCE(array_to_string(list_transform({listed}, lambda x: x.label), ','), '')) AS base_sha256
FROM found
"""


#: By start, then kind as listed; by kind as listed, then start.
SECRETS_BASE = base_sql(SECRETS, "list_sort(list_transform(list_concat(assign, access, hex), lambda x: {'start': x.start, 'kind': x.kind, 'label': x.label}))")
PII_BASE = base_sql(PII, "list_concat(email, ip, card, phone)")

IMATCH_EDITED = """
WITH own AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
beside AS (SELECT doc_id, t, COALESCE(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS n FROM own)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(n, length(t) // 2)) AS edited_sha256 FROM beside
"""

ORACLES = {"op1_embeddings": EMBEDDINGS, "op10_minhash": MINHASH, "secrets_base": SECRETS_BASE, "pii_base": PII_BASE, "imatch_edited": IMATCH_EDITED}
