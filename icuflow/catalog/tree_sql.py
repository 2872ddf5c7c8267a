"""DuckDB statements that grow tree ensembles by themselves: a recursive query whose step is one level of all trees.

They state the definition: bins at quantiles, draws by hash, best gain with ties to the first feature and bin, Newton leaves. The state of the recursion
is one row per model, class and table row, with the node the row has come to.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from icuflow.catalog.sampling import sql_draw
from icuflow.learn.trees import BINS, LEAST_GAIN, POISSON, PRIME, SCALE, Ensemble

S = f"{SCALE:.1f}::DOUBLE"


def scrambled(x: str, v: str) -> str:
    p = PRIME
    return f"list_transform([CAST(({x}) * 48271 + ({v}) AS BIGINT) % {p}], lambda q: ((q * q % {p}) * (q * q % {p}) % {p}) * q % {p})[1]"


def table_sql(rows: str) -> str:
    """CTEs on ``rows`` (id, x, y, learnt, fold): drawn rows, and the bin of every value by the quantiles of the rows that are learnt from."""
    shares = ", ".join(str(i / BINS) for i in range(1, BINS))
    return f"""
t_rows AS MATERIALIZED (SELECT *, CAST(floor({sql_draw('trees', 'id')} * {PRIME}) AS BIGINT) AS base FROM ({rows})),
t_values AS MATERIALIZED (SELECT id, learnt, unnest(range(0, len(x))) AS f, unnest(x) AS v FROM t_rows),
t_cuts AS MATERIALIZED (SELECT f, list_distinct(quantile_disc(v, [{shares}])) AS c FROM t_values WHERE learnt GROUP BY f),
t_bins AS MATERIALIZED (SELECT id, f, len(list_filter(c, lambda y: y < v)) AS b FROM t_values JOIN t_cuts USING (f)),
t_size AS MATERIALIZED (SELECT count(*) AS n FROM t_cuts)"""


def gain_sql(channels: int, g: str, h: str, whole: str, l2: str) -> str:
    """Gain of a split from the left child's sums ``g`` 0, 1, ... and ``h``, and the node's."""
    each = [f"{g}{c} * {g}{c} / ({h} + {l2}) + ({whole}{g}{c} - {g}{c}) * ({whole}{g}{c} - {g}{c}) / ({whole}{h} - {h} + {l2})" for c in range(channels)]
    return " + ".join(each) + "".join(f" - {whole}{g}{c} * {whole}{g}{c} / ({whole}{h} + {l2})" for c in range(channels))


def boosted_sql(name: str, cells: Sequence[Ensemble], history: bool = False) -> str:
    """CTE ``name`` (e, k, id, m): margins of all rows under all models, numbered by place; ``cells`` differ in depth, least, rate and fold only.

    With ``history`` every step is kept: (e, k, id, r, l, node, sf, sg, m), sf and sg the feature and gain by which a row's node was just left.
    """
    one = cells[0]
    if any(replace(c, depth=one.depth, least=one.least, rate=one.rate, fold=one.fold) != one for c in cells):
        raise ValueError("models of one statement share all other settings")
    spec = ", ".join(f"({i}, {c.depth}, {c.least}::DOUBLE, {c.rate}::DOUBLE, {-1 if c.fold is None else c.fold})" for i, c in enumerate(cells))
    outputs = one.outputs
    l2 = f"{one.l2}::DOUBLE"
    if one.loss == "squared":
        gradient, hessian, start = f"round_even((m - y) * {S}, 0)", S, "0.5::DOUBLE"
    else:
        target = "CAST(y = k AS INT)" if outputs > 1 else "y"
        gradient, hessian = f"round_even((p - {target}) * {S}, 0)", f"round_even(p * (1 - p) * {S}, 0)"
        start = "0.0::DOUBLE"
        if one.prior:
            n = lambda c: f"(SELECT count(*)::DOUBLE FROM t_rows u WHERE u.learnt AND u.y = {c} AND u.fold != c.fold)"
            start = f"ln({n(1)} / {n(0)})" if outputs == 1 else f"ln({n('k')} / (SELECT count(*)::DOUBLE FROM t_rows u WHERE u.learnt AND u.fold != c.fold))"
    if outputs == 1:
        prob = "1 / (1 + exp(-m))"
        margins = "cur"
    else:
        each = [f"exp(m{k} - mx)" for k in range(outputs)]
        prob = f"exp(m - mx) / ({' + '.join(each)})"
        ms = ", ".join(f"max(CASE WHEN k = {k} THEN m END) OVER (PARTITION BY e, id) AS m{k}" for k in range(outputs))
        margins = f"(SELECT *, greatest({', '.join(f'm{k}' for k in range(outputs))}) AS mx FROM (SELECT *, {ms} FROM cur))"
    drawn = f"AND {scrambled('base', scrambled(str(one.seed), 'r'))} < {one.rows * PRIME!r}" if one.rows < 1 else ""
    some = f"JOIN {name}_columns t ON t.r = d.r AND t.f = b.f" if one.columns < 1 else ""
    keyed = "" if history else "USING KEY (e, k, id)"
    return f"""
{name}_cells(e, depth, least, rate, fold) AS MATERIALIZED (VALUES {spec}),
{name}_columns AS MATERIALIZED (
  SELECT r, f FROM (SELECT r, f, row_number() OVER (PARTITION BY r ORDER BY {scrambled(scrambled(str(one.seed), 'r'), 'f')}, f) AS place
    FROM range(0, {one.rounds}) a(r), t_cuts) WHERE place <= greatest(1, (SELECT floor({one.columns}::DOUBLE * n) FROM t_size))),
{name}(e, k, id, r, l, y, base, learnt, m, more, node, sf, sg) {keyed} AS (
  SELECT e, CAST(k AS INT), id, 0, 0, y, base, learnt AND t.fold != c.fold, {start}, 0.0::DOUBLE, 1::BIGINT, -1::BIGINT, 0.0::DOUBLE
  FROM {name}_cells c, range(0, {outputs}) o(k), t_rows t
  UNION ALL
  SELECT * FROM (
    WITH cur AS MATERIALIZED (SELECT s.*, c.depth, c.least, c.rate FROM {name} s JOIN {name}_cells c USING (e) WHERE s.r < {one.rounds}),
    d AS MATERIALIZED (SELECT *, {gradient} AS g, {hessian} AS h FROM (SELECT *, {prob if one.loss != 'squared' else 'm'} AS p FROM {margins}) WHERE learnt AND node > 0 {drawn}),
    whole AS MATERIALIZED (SELECT e, k, node, sum(g) / {S} AS Wg0, sum(h) / {S} AS Wh FROM d GROUP BY ALL),
    cell AS (SELECT d.e, d.k, d.node, b.f, b.b, sum(g) AS g, sum(h) AS h FROM d JOIN t_bins b ON b.id = d.id {some} WHERE d.l < d.depth GROUP BY ALL),
    upto AS (SELECT e, k, node, f, b, sum(g) OVER w / {S} AS g0, sum(h) OVER w / {S} AS h FROM cell WINDOW w AS (PARTITION BY e, k, node, f ORDER BY b)),
    tried AS (SELECT u.e, u.k, u.node, f, b, {gain_sql(1, 'g', 'h', 'W', l2)} AS gain
      FROM upto u JOIN whole w ON w.e = u.e AND w.k = u.k AND w.node = u.node JOIN {name}_cells c ON c.e = u.e WHERE h >= c.least AND Wh - h >= c.least),
    best AS MATERIALIZED (SELECT * FROM tried WHERE gain > {LEAST_GAIN}
      QUALIFY row_number() OVER (PARTITION BY e, k, node ORDER BY gain DESC, f, b) = 1),
    deeper AS MATERIALIZED (SELECT DISTINCT e FROM best),
    moved AS (
      SELECT cur.*, best.f AS bf, best.gain AS bg, deeper.e IS NOT NULL AS goes_on,
        CASE WHEN cur.node > 0 AND best.f IS NOT NULL THEN 2 * cur.node + CAST(x.b > best.b AS INT) ELSE 0 END AS node2,
        CASE WHEN cur.node > 0 AND best.f IS NULL THEN -cur.rate * Wg0 / (Wh + {l2}) ELSE cur.more END AS more2
      FROM cur LEFT JOIN whole w ON w.e = cur.e AND w.k = cur.k AND w.node = cur.node
        LEFT JOIN best ON best.e = cur.e AND best.k = cur.k AND best.node = cur.node
        LEFT JOIN t_bins x ON x.id = cur.id AND x.f = best.f LEFT JOIN deeper ON deeper.e = cur.e)
    SELECT e, k, id, CASE WHEN goes_on THEN r ELSE r + 1 END, CASE WHEN goes_on THEN l + 1 ELSE 0 END, y, base, learnt,
      CASE WHEN goes_on THEN m ELSE m + more2 END, CASE WHEN goes_on THEN more2 ELSE 0.0 END, CASE WHEN goes_on THEN node2 ELSE 1 END,
      CASE WHEN bf IS NULL THEN -1 ELSE bf END, CASE WHEN bf IS NULL THEN 0.0 ELSE bg END
    FROM moved))"""


def forest_sql(name: str, cells: Sequence[Ensemble]) -> str:
    """CTE ``name`` (e, t, id, y, learnt, node, l, p0, p1, ...): leaf shares of every row in every tree; ``cells`` differ in fold only.

    The recursion keeps every step, with (sf, sg) the feature and gain by which a row's node was left; rows that have come to a leaf have p0.
    """
    one = cells[0]
    spec = ", ".join(f"({i}, {-1 if c.fold is None else c.fold})" for i, c in enumerate(cells))
    classes = range(one.classes)
    draw = scrambled("base", scrambled(str(one.seed), "t"))
    times = " + ".join(f"CAST(u >= {p!r}::DOUBLE AS INT)" for p in POISSON)
    sums = ", ".join(f"sum(w * CAST(y = {c} AS INT))::DOUBLE AS Wg{c}" for c in classes)
    parts = ", ".join(f"sum(w * CAST(y = {c} AS INT))::DOUBLE AS c{c}" for c in classes)
    least = f"{one.least}::DOUBLE"
    start = scrambled(scrambled(str(one.seed), "t"), "node")
    if one.kind == "extra":
        cut = scrambled(scrambled(scrambled(str(one.seed + 1), "t"), "node"), "f")
        upto = f"""
    edge AS (SELECT e, t, node, f, CAST(min(b) + ({cut}) * (max(b) - min(b)) // {PRIME} AS BIGINT) AS cut FROM cell GROUP BY e, t, node, f),
    upto AS (SELECT c.e, c.t, c.node, c.f, any_value(cut) AS b, {', '.join(f'sum(c{c}) AS g{c}' for c in classes)}, sum(ch) AS h
      FROM cell c JOIN edge z ON z.e = c.e AND z.t = c.t AND z.node = c.node AND z.f = c.f WHERE c.b <= cut GROUP BY c.e, c.t, c.node, c.f)"""
    else:
        upto = f"""
    upto AS (SELECT e, t, node, f, b, {', '.join(f'sum(c{c}) OVER w AS g{c}' for c in classes)}, sum(ch) OVER w AS h FROM cell
      WINDOW w AS (PARTITION BY e, t, node, f ORDER BY b))"""
    shares = ", ".join(f"CASE WHEN best.f IS NULL THEN Wg{c} / Wh END" for c in classes)
    return f"""
{name}_cells(e, fold) AS MATERIALIZED (VALUES {spec}),
{name}(e, t, id, l, y, w, learnt, node, sf, sg, {', '.join(f'p{c}' for c in classes)}) AS (
  SELECT e, t, id, 0, y, CASE WHEN learnt AND rfold != efold THEN {times} ELSE 0 END, learnt, 1::BIGINT, -1::BIGINT, 0.0::DOUBLE,
    {', '.join('NULL::DOUBLE' for _ in classes)}
  FROM (SELECT c.e, CAST(t AS INT) AS t, id, y, learnt, r.fold AS rfold, c.fold AS efold, ({draw}) / {PRIME}.0::DOUBLE AS u
    FROM {name}_cells c, range(0, {one.rounds}) o(t), t_rows r)
  UNION ALL
  SELECT * FROM (
    WITH cur AS MATERIALIZED (SELECT * FROM {name} WHERE p0 IS NULL),
    whole AS MATERIALIZED (SELECT e, t, node, {sums}, sum(w)::DOUBLE AS Wh FROM cur GROUP BY e, t, node),
    open AS (SELECT DISTINCT e, t, node FROM cur WHERE l < {one.depth}),
    look AS (SELECT e, t, node, f FROM open, t_cuts
      QUALIFY row_number() OVER (PARTITION BY e, t, node ORDER BY {scrambled(start, 'f')}, f) <= greatest(1, (SELECT floor({one.columns!r}::DOUBLE * n) FROM t_size))),
    cell AS MATERIALIZED (SELECT cur.e, cur.t, cur.node, k.f, b.b, {parts}, sum(w)::DOUBLE AS ch
      FROM cur JOIN look k ON k.e = cur.e AND k.t = cur.t AND k.node = cur.node JOIN t_bins b ON b.id = cur.id AND b.f = k.f WHERE w > 0 GROUP BY ALL),{upto},
    tried AS (SELECT u.e, u.t, u.node, f, b, {gain_sql(one.classes, 'g', 'h', 'W', f'{one.l2}::DOUBLE')} AS gain
      FROM upto u JOIN whole w ON w.e = u.e AND w.t = u.t AND w.node = u.node WHERE h >= {least} AND Wh - h >= {least}),
    best AS MATERIALIZED (SELECT * FROM tried WHERE gain > {LEAST_GAIN} QUALIFY row_number() OVER (PARTITION BY e, t, node ORDER BY gain DESC, f, b) = 1)
    SELECT cur.e, cur.t, cur.id, cur.l + 1, cur.y, cur.w, cur.learnt,
      CASE WHEN best.f IS NULL THEN cur.node ELSE 2 * cur.node + CAST(x.b > best.b AS INT) END,
      coalesce(best.f, -1), coalesce(best.gain, 0.0), {shares}
    FROM cur JOIN whole w ON w.e = cur.e AND w.t = cur.t AND w.node = cur.node
      LEFT JOIN best ON best.e = cur.e AND best.t = cur.t AND best.node = cur.node LEFT JOIN t_bins x ON x.id = cur.id AND x.f = best.f))"""
