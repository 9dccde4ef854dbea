"""DuckDB SQL of k-means trees: Lloyd steps inside nodes, levels, and the order of the splits."""

from __future__ import annotations

from pixelloom.plans.fixtures import VX

SIZE = 64
#: Rows x(id, f, y) and their components l(id, pos, v); y: 1 for digits 5-9.
ROWS = f"WITH {VX}, x AS MATERIALIZED (SELECT id, f, CASE WHEN label >= 5 THEN 1 ELSE 0 END::DOUBLE AS y, label FROM vx), l AS MATERIALIZED (SELECT id, unnest(range({SIZE})) AS pos, unnest(f) AS v FROM x)"


def distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def assigned(out: str, rows: str, centres: str) -> str:
    """out(id, node, far, child): rows(id, node) with the nearest of their node's centres(node, child, c)."""
    far = distance("any_value(x.f)", "any_value(c.c)")
    return f"""{out} AS MATERIALIZED (SELECT id, any_value(node) AS node, min({{'d': d, 'k': child}}).d AS far, min({{'d': d, 'k': child}}).k AS child
  FROM (SELECT r.id, c.node, c.child, {far} AS d FROM {rows} r JOIN x USING (id) JOIN {centres} c ON r.node = c.node GROUP BY r.id, c.node, c.child) GROUP BY id)"""


def moved(out: str, assigned_: str, centres: str) -> str:
    """out(node, child, c): the means of the assigned rows; centres without rows stay."""
    return f"""{out} AS MATERIALIZED (SELECT o.node, o.child, coalesce(m.c, o.c) AS c FROM {centres} o LEFT JOIN (SELECT node, child, list(m ORDER BY pos) AS c
  FROM (SELECT node, child, pos, avg(v) AS m FROM {assigned_} JOIN l USING (id) GROUP BY ALL) GROUP BY node, child) m ON o.node = m.node AND o.child = m.child)"""


def settled(name: str, rows: str, starts: str, steps: int) -> tuple[list[str], str]:
    """CTEs of the steps from starts, and the name of the last centres."""
    out, now = [], starts
    for k in range(steps):
        out += [assigned(f"{name}_a{k}", rows, now), moved(f"{name}_c{k}", f"{name}_a{k}", now)]
        now = f"{name}_c{k}"
    return out, now


def figures(out: str, rows: str) -> str:
    """out(node, n, spread, p, variance, mean, deviation) of rows(id, node)."""
    return f"""{out} AS MATERIALIZED (SELECT node, n, spread, p, variance, mean, deviation FROM (SELECT node, count(*) AS n, avg(y) AS p, var_pop(y) AS variance FROM {rows} JOIN x USING (id) GROUP BY node)
  JOIN (SELECT node, sum(w) AS spread, list(m ORDER BY pos) AS mean, list(sqrt(w) ORDER BY pos) AS deviation FROM (SELECT node, pos, avg(v) AS m, var_pop(v) AS w FROM {rows} JOIN l USING (id) GROUP BY ALL) GROUP BY node) USING (node))"""


#: Costs over a row of figures, as the library has them.
COSTS = {
    "spread": "sqrt(spread * n) + 100 * greatest(p, 1 - p) + n / 1000",
    "purity": "1 - greatest(p, 1 - p)",
    "variance": "variance",
    "loss": "(CASE WHEN p IN (0, 1) THEN 0 ELSE -p * ln(p) - (1 - p) * ln(1 - p) END) * ln(n)",
}
ENTROPY = "-greatest(p, 0) * ln(greatest(p, 1e-12)) - (1 - p) * ln(greatest(1 - p, 1e-12))"


def binary_tree(cost: str, leaves: int, least: int, guided: bool = False, steps: int = 5) -> str:
    """CTEs up to tree(node, parent, n, p, mean, leaf): all nodes of `leaves` - 1 levels, then the splits in order of cost."""
    ctes = ["a0 AS MATERIALIZED (SELECT id, 'R' AS node FROM x)", figures("s0", "a0")]
    for level in range(leaves - 1):
        ctes.append(f"b{level}(node, child, c) AS (SELECT node, k, CASE WHEN k = 0 THEN list_transform(list_zip(mean, deviation), lambda z: z[1] - z[2]) ELSE list_transform(list_zip(mean, deviation), lambda z: z[1] + z[2]) END FROM s{level}, (SELECT unnest([0, 1]) AS k) WHERE n >= {2 * least} AND spread > 0)")
        more, last = settled(f"t{level}", f"a{level}", f"b{level}", steps)
        ctes += [*more, assigned(f"z{level}", f"a{level}", last), f"a{level + 1} AS MATERIALIZED (SELECT id, node || child AS node FROM z{level})", figures(f"s{level + 1}", f"a{level + 1}")]
    every = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(leaves))
    ctes.append(f"f AS MATERIALIZED (SELECT *, left(node, -1) AS parent, {COSTS[cost]} AS cost, {ENTROPY} AS h FROM ({every}))")
    better = " AND sum(c.n * c.h) / any_value(f.n) < any_value(f.h)" if guided else ""
    ctes.append(f"able AS MATERIALIZED (SELECT f.node, f.parent, any_value(f.cost) AS cost FROM f JOIN f c ON c.parent = f.node WHERE f.n >= {2 * least} AND f.spread > 0 GROUP BY f.node, f.parent HAVING count(*) = 2{better})")
    for k in range(leaves - 1):
        before = " UNION ALL ".join(f"SELECT node FROM p{j}" for j in range(k))
        where = f"parent IN ({before}) AND node NOT IN ({before})" if k else "node = 'R'"
        ctes.append(f"p{k} AS MATERIALIZED (SELECT node FROM able WHERE {where} ORDER BY cost DESC, node DESC LIMIT 1)")
    picks = " UNION ALL ".join(f"SELECT node FROM p{k}" for k in range(leaves - 1))
    ctes.append(f"tree AS MATERIALIZED (SELECT *, node NOT IN ({picks}) AS leaf FROM f WHERE node = 'R' OR parent IN ({picks}))")
    return ROWS + ",\n" + ",\n".join(ctes)


def routed() -> str:
    """CTEs after binary_tree(): own(id, node), the leaf that the splits gave, and near(id, node), that of the nearest centroid."""
    deepest = " UNION ALL ".join(f"SELECT id, node FROM a{k} JOIN tree USING (node) WHERE leaf" for k in range(3))
    far = distance("x.f", "t.mean")
    return f"own AS MATERIALIZED ({deepest}),\nnear AS MATERIALIZED (SELECT id, min_by(node, {{'d': d, 'n': node}}) AS node FROM (SELECT id, node, {far} AS d FROM x, tree t WHERE leaf) GROUP BY id)"


def full_tree(k: int, depth: int, steps: int = 10) -> str:
    """CTEs up to a{depth}(id, node): every node split into k from its rows of lowest SHA-256 of the id."""
    ctes = ["a0 AS MATERIALIZED (SELECT id, 'R' AS node FROM x)"]
    for level in range(depth):
        ctes.append(f"b{level}(node, child, c) AS MATERIALIZED (SELECT node, row_number() OVER (PARTITION BY node ORDER BY sha256(id::VARCHAR)) - 1 AS child, f FROM a{level} JOIN x USING (id) QUALIFY child < {k})")
        more, last = settled(f"t{level}", f"a{level}", f"b{level}", steps)
        ctes += [*more, assigned(f"z{level}", f"a{level}", last), f"a{level + 1} AS MATERIALIZED (SELECT id, node || child AS node FROM z{level})"]
    return ROWS + ",\n" + ",\n".join(ctes)


def lbg(how: str, steps: int) -> tuple[list[str], str]:
    """CTEs of a 2-means from mean and deviation of all rows; the last assignment's name. Needs r(id, node) and g, the figures of it."""
    minus, plus = (f"list_transform(list_zip(mean, deviation), lambda z: z[1] {s} z[2])" for s in "-+")
    first, second = {"plus": ("mean", plus), "minus": ("mean", minus), "both": (minus, plus)}[how]
    ctes = [f"b_{how}(node, child, c) AS (SELECT node, k, CASE WHEN k = 0 THEN {first} ELSE {second} END FROM g, (SELECT unnest([0, 1]) AS k))"]
    more, _ = settled(how, "r", f"b_{how}", steps)
    return ctes + more, f"{how}_a{steps - 1}"
