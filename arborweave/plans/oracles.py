"""SQL with the same rows as the queries, from relational definitions of the operators."""

from __future__ import annotations

from arborweave.plans.graphs import adjacency_sql

VLEN = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 WHEN {0} < 34359738368 THEN 5 ELSE 6 END"

ROWS = """
freq AS (SELECT dst, count(*) AS freq FROM {adj} GROUP BY dst),
rws AS MATERIALIZED (SELECT a.src, a.dst, f.freq, row_number() OVER (PARTITION BY a.src ORDER BY f.freq DESC, a.dst) - 1 AS pos FROM {adj} a JOIN freq f ON a.dst = f.dst),
nb AS (SELECT * FROM (SELECT src, dst AS child, freq AS child_freq, lag(dst) OVER w AS parent, lag(freq) OVER w AS parent_freq FROM rws WINDOW w AS (PARTITION BY src ORDER BY pos)) WHERE parent IS NOT NULL),
ff AS MATERIALIZED (SELECT child, arg_min(parent, src) AS parent FROM nb GROUP BY child)"""

GAIN = f"""
pairs AS (SELECT src, parent, child, ({VLEN.format('(parent * 2)')}) - 1 AS gain,
  (({VLEN.format('(parent * 2)')}) - 1) + 0.20::DOUBLE * (parent_freq::DOUBLE / child_freq::DOUBLE) - 0.05::DOUBLE * (({VLEN.format('(child * 2 + 1)')}) - 1) AS score FROM nb),
cand AS (SELECT child, parent, count(*) AS support, sum(score) AS score FROM pairs WHERE gain > 0 GROUP BY child, parent),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY round(score, 9) DESC, support DESC, parent) AS k FROM cand) WHERE k = 1),
par AS MATERIALIZED (SELECT ff.child, CASE WHEN b.support >= 2 AND b.score >= 2.0 THEN b.parent ELSE ff.parent END AS parent,
  coalesce(b.support >= 2 AND b.score >= 2.0 AND b.parent <> ff.parent, false) AS switched FROM ff LEFT JOIN best b ON b.child = ff.child)"""

#: In-row tree: every node's rightmost descendant gives its command; every node's ancestors give candidate chains.
WALK = """
up AS (SELECT r.src, r.pos, r.dst, q.pos AS parent_pos, q.dst AS parent_dst FROM rws r LEFT JOIN {par} p ON p.child = r.dst LEFT JOIN rws q ON q.src = r.src AND q.dst = p.parent),
walk AS (SELECT src, pos AS bottom_pos, dst AS bottom, pos, dst, parent_pos, parent_dst, 0 AS d FROM up
  UNION ALL SELECT w.src, w.bottom_pos, w.bottom, u.pos, u.dst, u.parent_pos, u.parent_dst, w.d + 1 FROM walk w JOIN up u ON u.src = w.src AND u.pos = w.parent_pos),
rightmost AS (SELECT src, pos, dst, max(bottom_pos) AS m FROM walk GROUP BY src, pos, dst),
greedy AS MATERIALIZED (SELECT g.src, g.m AS bottom_pos, r.dst AS bottom, g.n - 1 AS steps FROM (SELECT src, m, count(*) AS n FROM rightmost GROUP BY src, m) g JOIN rws r ON r.src = g.src AND r.pos = g.m)"""

PLAN = f"""
chains AS (SELECT src, bottom_pos, bottom, max(d) AS steps, arg_max(pos, d) AS root, sum(CASE WHEN d > 0 THEN {VLEN.format('(dst * 2)')} ELSE 0 END) - ({VLEN.format('max(d)')}) AS gain FROM walk GROUP BY src, bottom_pos, bottom),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, root ORDER BY gain DESC, steps DESC, bottom) AS k FROM chains WHERE steps > 0 AND gain > 0) WHERE k = 1),
covered AS (SELECT DISTINCT w.src, w.pos FROM walk w JOIN picked p ON p.src = w.src AND p.bottom_pos = w.bottom_pos),
cand_cmds AS (SELECT src, bottom_pos, bottom, steps FROM picked UNION ALL SELECT r.src, r.pos, r.dst, 0 FROM rws r LEFT JOIN covered c ON c.src = r.src AND c.pos = r.pos WHERE c.pos IS NULL),
totals AS (SELECT src, sum(g) AS g, sum(c) AS c FROM (SELECT src, {{cost}} AS g, 0 AS c FROM greedy UNION ALL SELECT src, 0, {{cost}} FROM cand_cmds) GROUP BY src),
chosen AS MATERIALIZED (SELECT x.* FROM greedy x JOIN totals t ON t.src = x.src WHERE t.c >= t.g UNION ALL SELECT x.* FROM cand_cmds x JOIN totals t ON t.src = x.src WHERE t.c < t.g)"""

COST = f"(CASE WHEN steps > 0 THEN ({VLEN.format('(bottom * 2 + 1)')}) + ({VLEN.format('steps')}) ELSE ({VLEN.format('(bottom * 2)')}) END)"


def metrics(codec: str, n: str, b: str, source: str) -> str:
    return f"SELECT '{codec}' AS codec, CAST({n} AS BIGINT) AS n_edges, CAST({b} AS BIGINT) AS bytes, round({b} / 1048576.0::DOUBLE, 6) AS data_mb, round({b} * 8.0::DOUBLE / {n}, 6) AS bpe, round({b} * 25.0::DOUBLE / {n}, 6) AS ratio_pct FROM {source}"


def with_adj(name: str, body: str, directed: bool = False, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{adjacency_sql(name, directed)}{body}"


def with_rows(name: str, body: str, adj: str = "adj", extra: str = "") -> str:
    return with_adj(name, f",{extra}{ROWS.format(adj=adj)}{body}", recursive=True)


def tree(name: str, body: str) -> str:
    return with_rows(name, "," + WALK.format(par="ff") + body)


def optimised(name: str, body: str) -> str:
    """Neighbours are renumbered by score; rows keep their old ids."""
    extra = f"""{RELABEL_SCORE},
renamed AS MATERIALIZED (SELECT a.src, m.new_id AS dst FROM adj a JOIN by_score m ON m.old_id = a.dst),"""
    return with_rows(name, "," + GAIN + "," + WALK.format(par="par") + "," + PLAN.format(cost=COST) + body, adj="renamed", extra=extra)


VERTICES = "ids AS (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) + 1 FROM adj))) AS id)"
RELABEL_DEGREE = f"""{VERTICES},
by_degree AS (SELECT id AS old_id, row_number() OVER (ORDER BY coalesce(d, 0) DESC, id) - 1 AS new_id FROM ids LEFT JOIN (SELECT src, count(*) AS d FROM adj GROUP BY src) x ON x.src = id)"""
RELABEL_SCORE = f"""{VERTICES},
how_often AS (SELECT dst AS id, count(*) AS n FROM adj GROUP BY dst),
sides AS (SELECT dst, lag(dst) OVER w IS NOT NULL AS has_left, lead(dst) OVER w IS NOT NULL AS has_right FROM adj JOIN how_often h ON h.id = dst WINDOW w AS (PARTITION BY src ORDER BY n DESC, dst)),
counts AS (SELECT dst AS id, count(*) AS f, count(*) FILTER (has_right) AS p, count(*) FILTER (has_left) AS b FROM sides GROUP BY dst),
scored AS (SELECT ids.id, coalesce(f, 0) AS frequency, coalesce(p, 0) AS followed, coalesce(b, 0) AS preceded, 1.00::DOUBLE * coalesce(f, 0) + 0.75::DOUBLE * coalesce(p, 0) + 0.50::DOUBLE * coalesce(b, 0) AS score FROM ids LEFT JOIN counts c ON c.id = ids.id),
by_score AS (SELECT id AS old_id, row_number() OVER (ORDER BY score DESC, frequency DESC, id) - 1 AS new_id FROM scored)"""
GAPS = "gaps AS (SELECT src, dst, dst - coalesce(lag(dst) OVER (PARTITION BY src ORDER BY dst), 0) AS gap FROM adj)"
REACH = "reach AS (SELECT src AS a, src AS b FROM adj UNION SELECT r.a, e.dst FROM reach r JOIN adj e ON e.src = r.b)"
LABELS = f"{VERTICES}, {REACH}, labels AS (SELECT ids.id, coalesce(m, ids.id) AS component FROM ids LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) x ON x.a = ids.id)"
TRIANGLES = "tri AS (SELECT x.src AS u, x.dst AS v, y.dst AS w FROM adj x JOIN adj y ON y.src = x.dst AND x.src < x.dst AND y.src < y.dst JOIN adj z ON z.src = x.src AND z.dst = y.dst)"
BFS = """start AS (SELECT src AS id FROM adj GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
steps AS (SELECT id, 0 AS level FROM start UNION SELECT e.dst, s.level + 1 FROM steps s JOIN adj e ON e.src = s.id WHERE s.level < 40),
levels AS (SELECT id, CAST(min(level) AS INTEGER) AS level FROM steps GROUP BY id)"""
