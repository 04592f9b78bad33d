"""Building blocks of the SQL that checks the queries (DuckDB dialect)."""

from __future__ import annotations

from ..sources.testdata import FOREST_SQL, TRIPLETS_SQL


def norm(column: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({column}, '')), '\\s+', ' ', 'g'))"


PARTS = {
    "trip": TRIPLETS_SQL.strip(),
    "forest": FOREST_SQL,
    "qual": "qual AS (SELECT kind, ord, sample_id, relation AS main, q.relation AS q_relation, q.object AS q_object, q.object_type AS q_type FROM (SELECT *, unnest(qualifiers) AS q FROM trip))",
    "tsurf": "tsurf AS (SELECT trim(subject_type) AS surface FROM trip UNION ALL SELECT trim(object_type) FROM trip UNION ALL SELECT trim(q_type) FROM qual)",
    "rsurf": "rsurf AS (SELECT trim(relation) AS surface FROM trip UNION ALL SELECT trim(q_relation) FROM qual)",
    "tvoc": f"tvoc AS (SELECT n AS label, 'type_' || lpad(CAST(row_number() OVER (ORDER BY n) - 1 AS VARCHAR), 4, '0') AS item_id FROM (SELECT DISTINCT {norm('surface')} AS n FROM tsurf WHERE surface <> ''))",
    "rvoc": f"rvoc AS (SELECT n AS label, 'rel_' || lpad(CAST(row_number() OVER (ORDER BY n) - 1 AS VARCHAR), 5, '0') AS item_id FROM (SELECT DISTINCT {norm('surface')} AS n FROM rsurf WHERE surface <> ''))",
    "typed": f"typed AS (SELECT kind, ord, sample_id, {norm('relation')} AS relation_id, relation AS surface, subject, object, {norm('subject_type')} AS st, {norm('object_type')} AS ot FROM trip)",
    "tnodes": "tnodes AS (SELECT st AS node FROM typed UNION SELECT ot FROM typed UNION SELECT child FROM forest UNION SELECT parent FROM forest)",
    "up": "up AS (SELECT node, node AS ancestor, 0 AS depth FROM tnodes UNION ALL SELECT u.node, f.parent, u.depth + 1 FROM up u JOIN forest f ON u.ancestor = f.child)",
    "rootof": "rootof AS (SELECT node, arg_max(ancestor, depth) AS root, max(depth) AS height FROM up GROUP BY node)",
    "roles": f"roles AS (SELECT DISTINCT relation, role, type FROM (SELECT {norm('relation')} AS relation, 'subject' AS role, {norm('subject_type')} AS type FROM trip UNION ALL SELECT {norm('relation')}, 'object', {norm('object_type')} FROM trip UNION ALL SELECT {norm('q_relation')}, 'object', {norm('q_type')} FROM qual) WHERE type <> '')",
    "counts": "counts AS (SELECT type, relation, CAST(count(*) AS DOUBLE) AS weight FROM roles GROUP BY type, relation)",
    "ppmi": """ppmi AS (SELECT type, relation, weight FROM (SELECT type, relation, ln(weight * sum(weight) OVER () / (sum(weight) OVER (PARTITION BY type) * sum(weight) OVER (PARTITION BY relation))) AS weight FROM counts) WHERE weight > 0)""",
    "pairs": "pairs AS (SELECT x.type AS a, y.type AS b, x.relation, x.weight AS wa, y.weight AS wb FROM ppmi x JOIN ppmi y ON x.relation = y.relation AND x.type < y.type)",
    "weeds": """weeds AS (SELECT child, parent, shared / whole AS precision FROM (SELECT child, parent, sum(w) AS shared FROM (SELECT a AS child, b AS parent, wa AS w FROM pairs UNION ALL SELECT b, a, wb FROM pairs) GROUP BY child, parent) JOIN (SELECT type, sum(weight) AS whole FROM ppmi GROUP BY type) ON type = child)""",
    "sig": """seen AS (SELECT DISTINCT relation_id, 'domain' AS role, st AS node FROM typed UNION SELECT DISTINCT relation_id, 'range', ot FROM typed),
rooted AS (SELECT s.*, r.root FROM seen s JOIN rootof r USING (node)),
wanted AS (SELECT relation_id, role, root, count(*) AS n FROM rooted GROUP BY ALL),
met AS (SELECT relation_id, role, root, ancestor, count(*) AS m FROM rooted JOIN up USING (node) GROUP BY ALL),
common AS (SELECT relation_id, role, root, arg_max(ancestor, h.height) AS signature FROM met JOIN wanted USING (relation_id, role, root) JOIN (SELECT node AS ancestor, height FROM rootof) h USING (ancestor) WHERE m = n GROUP BY ALL),
sig AS (SELECT relation_id, role, node, signature FROM rooted JOIN common USING (relation_id, role, root))""",
    "support": """support AS (SELECT relation_id, d.signature AS dom, r.signature AS rng, count(*) AS support FROM typed JOIN (SELECT relation_id, node AS st, signature FROM sig WHERE role = 'domain') d USING (relation_id, st) JOIN (SELECT relation_id, node AS ot, signature FROM sig WHERE role = 'range') r USING (relation_id, ot) GROUP BY ALL),
constr AS (SELECT relation_id, dom, rng, support, CAST(sum(support) OVER (PARTITION BY relation_id) AS BIGINT) AS total FROM support),
tiered AS (SELECT *, support / total AS p, CASE WHEN support / total >= 0.9 AND support >= 3 THEN 'hard' WHEN support / total >= 0.5 THEN 'soft' WHEN support / total >= 0.2 THEN 'hint' ELSE 'below_hint' END AS strength FROM constr)""",
}
NEEDS = {
    "qual": ["trip"], "tsurf": ["trip", "qual"], "rsurf": ["trip", "qual"], "tvoc": ["tsurf"], "rvoc": ["rsurf"], "typed": ["trip"], "tnodes": ["typed", "forest"], "up": ["tnodes"],
    "rootof": ["up"], "roles": ["trip", "qual"], "counts": ["roles"], "ppmi": ["counts"], "pairs": ["ppmi"], "weeds": ["pairs"], "sig": ["typed", "rootof"], "support": ["sig"],
}


def sql(body: str, *parts: str, more: str = "") -> str:
    """``body`` after the common table expressions it needs, and ``more`` of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for part in parts:
        add(part)
    heads = [PARTS[p] for p in order] + ([more] if more else [])
    return (f"WITH RECURSIVE {', '.join(heads)} " if heads else "") + body
