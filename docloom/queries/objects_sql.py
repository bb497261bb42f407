"""SQL (DuckDB) for the identities of nested elements, written apart from the operator to check it."""

from __future__ import annotations

#: Levels of nesting below an element that the statement follows.
LEVELS = 8
#: Exact text of a JSON number without trailing zeros; exponents don't occur in the typed table and are not read here.
NUMBER = "CASE WHEN {0} LIKE '%.%' THEN CASE WHEN rtrim(rtrim({0}, '0'), '.') IN ('0', '-0') THEN '0' ELSE rtrim(rtrim({0}, '0'), '.') END ELSE CASE WHEN {0} = '-0' THEN '0' ELSE {0} END END"
KIND = "CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"


def hashed(kind: str, content: str) -> str:
    return f"substr(sha256({kind} || ':' || {content}), 1, 32)"


def objects(elements: str) -> str:
    """Of a query of elements (e: JSON, nulls: whether fields that are null are there) the distinct ones and their number."""
    parts = [
        f"each AS (SELECT row_number() OVER () AS el, e, nulls, n FROM (SELECT e::VARCHAR AS e, nulls, count(*) AS n FROM ({elements}) GROUP BY ALL))",
        f"""tree AS (SELECT x.el, t.id, t.parent, t.key, {KIND} AS kind, t.atom, x.nulls FROM each x, json_tree(x.e::JSON) t)""",
        "kept AS (SELECT a.* FROM tree a LEFT JOIN tree p ON p.el = a.el AND p.id = a.parent WHERE a.nulls OR a.kind <> 'null' OR coalesce(p.kind, '') <> 'object')",
        f"leaves AS (SELECT el, id, parent, key, kind, CASE kind WHEN 'number' THEN {NUMBER.format('CAST(atom AS VARCHAR)')} WHEN 'string' THEN CAST(atom AS VARCHAR) WHEN 'null' THEN 'null' ELSE CAST(atom AS VARCHAR) END AS content FROM kept WHERE kind NOT IN ('object', 'array'))",
        "depth0 AS (SELECT el, id, parent, key, kind, 0 AS depth FROM kept WHERE parent IS NULL)",
    ]
    for d in range(1, LEVELS + 1):
        parts.append(f"depth{d} AS (SELECT k.el, k.id, k.parent, k.key, k.kind, {d} AS depth FROM kept k JOIN depth{d - 1} p ON p.el = k.el AND p.id = k.parent)")
    below = "SELECT NULL::BIGINT AS el, NULL::UBIGINT AS id, NULL::UBIGINT AS parent, NULL::VARCHAR AS key, NULL::VARCHAR AS kind, NULL::VARCHAR AS content, NULL::VARCHAR AS node WHERE false"
    parts.append(f"nodes{LEVELS + 1} AS ({below})")
    for d in range(LEVELS, -1, -1):
        children = f"""SELECT el, parent, '[' || string_agg('[' || to_json(key)::VARCHAR || ',"' || node || '"]', ',' ORDER BY key) || ']' AS fields, '[' || string_agg('"' || node || '"', ',' ORDER BY id) || ']' AS items FROM nodes{d + 1} GROUP BY el, parent"""
        parts.append(
            f"""nodes{d} AS (SELECT *, {hashed("kind", "content")} AS node FROM (
              SELECT a.el, a.id, a.parent, a.key, a.kind, CASE a.kind WHEN 'object' THEN coalesce(c.fields, '[]') WHEN 'array' THEN coalesce(c.items, '[]') ELSE l.content END AS content
              FROM depth{d} a LEFT JOIN leaves l ON l.el = a.el AND l.id = a.id LEFT JOIN ({children}) c ON c.el = a.el AND c.parent = a.id))"""
        )
    return f"WITH {', '.join(parts)} SELECT z.node AS node_id, any_value(z.kind) AS node_type, any_value(z.content) AS content, CAST(sum(x.n) AS BIGINT) AS occurrences FROM nodes0 z JOIN each x USING (el) GROUP BY 1"
