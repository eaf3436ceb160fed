"""SQL (DuckDB) for the operators that SQL can express."""

from __future__ import annotations

from .licenses import LINE_ENDS, OTHERS, RULES, SPLIT, sentence_steps
from .secrets import BASE, CLASSES, KINDS, WEAK

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secrets_sql(scope: int = 200) -> str:
    """Positions are running sums of the gaps and matches before."""
    spans = []
    for k in KINDS:
        pattern, group, least, _ = (BASE | WEAK)[k]
        whole = quoted(f"(?s)(.*?)({pattern})")
        parts = ", ".join(f"list_transform(regexp_extract_all(t, {whole}, {g}), lambda x: length(x)) AS {n}" for g, n in ((1, "gap"), (2, "n"), (group, "v")))
        spans.append(
            f"SELECT doc_id, '{k}' AS kind, '{CLASSES[k]}' AS class, {KINDS.index(k)} AS rank, e - n AS first, e AS last FROM "
            "(SELECT doc_id, n, v, sum(gap + n) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM "
            "(SELECT doc_id, unnest(gap) AS gap, unnest(n) AS n, unnest(v) AS v, unnest(range(len(n))) AS i FROM "
            f"(SELECT doc_id, {parts} FROM d))) WHERE v >= {least}"
        )
    weak = ", ".join(quoted(k) for k in WEAK)
    near = f"b.doc_id = a.doc_id AND b.first BETWEEN a.first - {scope} AND a.last + {scope}"
    has = lambda c: f"EXISTS (SELECT 1 FROM spans b WHERE {near} AND b.class = '{c}')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({' UNION ALL '.join(spans)}),
told AS (SELECT doc_id, kind, rank, first, kind || ':' || first::BIGINT || ':' || last::BIGINT AS s FROM spans a WHERE kind NOT IN ({weak})
  OR class = 'id' AND {has('secret')} OR class = 'secret' AND {has('id')} OR class = 'endpoint' AND {has('id')} AND {has('secret')}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(s, ',' ORDER BY first, rank) FILTER (rank < {len(BASE)}) AS base,
  string_agg(s, ',' ORDER BY first, rank) AS spans, count(*) FILTER (rank >= {len(BASE)}) AS n_linked FROM told GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN g USING (doc_id)
"""


def warc_sql() -> str:
    """Base32 out of the hexadecimal digest, forty bits at a time."""
    letters = quoted("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    base32 = " || ".join(f"substr({letters}, ((('0x' || substr(h, {1 + 10 * i}, 10))::BIGINT >> {35 - 5 * j}) & 31)::INT + 1, 1)" for i in range(4) for j in range(8))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, {base32} AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to FROM p
"""


def licenses_sql() -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches(line, {quoted(',' + ',(?:[^,]*,)*'.join(x.replace('.', chr(92) + '.') for x in seq) + ',')}) THEN {quoted(name)} END" for name, seq in RULES)
    found = "line"
    for pattern, ids in sentence_steps():
        found = f"regexp_replace({found}, {quoted(pattern)}, {quoted(ids)}, 'g')"
    return rf"""
WITH c AS (SELECT doc_id, regexp_replace(lower(regexp_replace(coalesce(text, ''), {quoted(SPLIT)}, '|' || chr(10), 'g')), {quoted(OTHERS)}, ' ', 'g') AS t FROM documents),
s AS (SELECT doc_id, '|' || trim(regexp_replace(t, {quoted(LINE_ENDS)}, '||', 'g')) || '|' AS line FROM c),
f AS (SELECT doc_id, {found} AS found FROM s),
i AS (SELECT doc_id, regexp_extract_all(found, '\|#([^|]+)', 1) AS ids FROM f),
l AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS line FROM i),
r AS (SELECT doc_id, ids, list_filter([{tests}], lambda x: x IS NOT NULL) AS names FROM l),
u AS (SELECT doc_id, ids, list_filter(names, lambda x, k: list_position(names, x) = k AND NOT (x = 'BSD-2-Clause' AND list_contains(names, 'BSD-3-Clause'))) AS names FROM r)
SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(names, ',') AS licenses FROM u
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": EXACT, "op3_secrets": secrets_sql(), "op6_warc": warc_sql(), "op10_licenses": licenses_sql()}
