"""Plain-SQL statements of the named queries, for an independent engine.

Every statement is self-contained: `_sql` prefixes the common table expressions
it names, with their dependencies.  Nothing here is used by the operators.
"""

from __future__ import annotations

from peerwatch.labels import HEADINGS

P31, P32 = 2147483647, 4294967291
A, B, C = 433494437, 715827883, 1431655777

START, END = "DATE '1996-01-01'", "DATE '2001-06-01'"
O_START, O_END = "DATE '1996-01-01'", "DATE '1996-12-01'"

TREES, PSI, HEIGHT, SEED = 200, 256, 8, 42


def _hash(*parts) -> str:
    """The row hash as nested list reductions, so that no operand is repeated in the text."""
    items = ", ".join(f"CAST({p} AS BIGINT)" for p in parts)
    folded = (
        f"list_reduce([CAST(0 AS BIGINT), {items}], lambda h, v: "
        f"(((h + ((v % {P31}) + {P31}) % {P31}) * {A} + 12345) % {P32} * {B} + 1) % {P31})"
    )
    once = f"list_reduce([{folded}, 15], lambda h, s: (xor(h, h >> CAST(s AS INTEGER)) * {C}) % {P32})"
    return f"list_reduce([{once}, 13], lambda h, s: (xor(h, h >> CAST(s AS INTEGER)) * {B}) % {P32})"


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round_even({n}, {digits}) AS {n}" for n in names)


def _pct(part: str, whole: str, digits: int | None = 2) -> str:
    value = f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100"
    return value if digits is None else f"round_even({value}, {digits})"


def _monthly(source: str) -> str:
    return f"""SELECT entity_id, CAST(date_trunc('month', event_ts) AS DATE) AS month, count(*) AS total,
        count(*) FILTER (WHERE cancelled) AS cancelled_n, count(*) FILTER (WHERE NOT cancelled) AS not_cancelled_n,
        count(*) FILTER (WHERE cancelled IS NULL) AS null_flag_n FROM {source} GROUP BY ALL"""


_FLAG = "CASE l_returnflag WHEN 'R' THEN true WHEN 'N' THEN false END AS cancelled"
_IDX = "(year(month) * 12 + month(month))"

# name -> (statement, names it reads)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "tx": (f"SELECT l_suppkey AS entity_id, l_shipdate AS event_ts, {_FLAG} FROM lineitem", ()),
    "months": (_monthly("tx"), ("tx",)),
    "bad_tx": (
        f"""SELECT l_suppkey AS entity_id, TRY_CAST(CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN 'n/a'
        ELSE CAST(l_shipdate AS VARCHAR) END AS TIMESTAMP) AS event_ts, {_FLAG} FROM lineitem""",
        (),
    ),
    "bad_months": (_monthly("bad_tx"), ("bad_tx",)),
    "bad_reasons": (
        f"""SELECT *, CASE WHEN month IS NULL THEN 'Datas inválidas' WHEN month < {START} THEN 'Antes de 1996'
        WHEN month > {END} THEN 'Após junho de 2001' END AS reason FROM bad_months""",
        ("bad_months",),
    ),
    "otx": (
        """SELECT o_custkey AS entity_id, o_orderdate AS event_ts,
        CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS cancelled FROM orders""",
        (),
    ),
    "omonths": (_monthly("otx"), ("otx",)),
    "oentities": (
        f"""SELECT entity_id, count(*) AS before_n,
        count(*) FILTER (WHERE month BETWEEN {O_START} AND {O_END}) AS after_n FROM omonths GROUP BY 1""",
        ("omonths",),
    ),
    "oshare": (
        f"SELECT *, before_n - after_n AS removed_n, {_pct('before_n - after_n', 'before_n')} AS removed_pct FROM oentities",
        ("oentities",),
    ),
    "kept": (f"SELECT * FROM months WHERE month BETWEEN {START} AND {END}", ("months",)),
    "feat": (
        "SELECT *, cancelled_n / CAST(greatest(total, 1) AS DOUBLE) AS rate, ln(1 + total) AS log_total FROM kept",
        ("kept",),
    ),
    "cuts": (
        "SELECT quantile_cont(total, 0.25) AS c1, quantile_cont(total, 0.5) AS c2, quantile_cont(total, 0.75) AS c3 FROM feat",
        ("feat",),
    ),
    "base": (
        """SELECT feat.*, CAST(total > c1 AS INTEGER) + CAST(total > c2 AS INTEGER) + CAST(total > c3 AS INTEGER)
        AS peer_group FROM feat, cuts""",
        ("feat", "cuts"),
    ),
    "stats": (
        """SELECT peer_group, count(*) AS group_n, avg(rate) AS rate_mean, quantile_cont(rate, 0.5) AS rate_median,
        greatest(coalesce(stddev_samp(rate), 0), 1e-9) AS rate_std, quantile_cont(rate, 0.9) AS rate_p90,
        avg(total) AS total_mean, CAST(quantile_cont(total, 0.5) AS DOUBLE) AS total_median FROM base GROUP BY 1""",
        ("base",),
    ),
    "scored": (
        """SELECT b.*, s.rate_mean, s.rate_std, (rate - rate_mean) / rate_std AS z, (rate - rate_mean) * 100 AS gap_pp,
        CASE WHEN rate_mean > 0 THEN rate / rate_mean END AS ratio FROM base b JOIN stats s USING (peer_group)""",
        ("base", "stats"),
    ),
    "log_scale": (
        """SELECT b.*, (log_total - m) / s AS x
        FROM base b, (SELECT avg(log_total) AS m, stddev_pop(log_total) AS s FROM base)""",
        ("base",),
    ),
    "centres": ("SELECT peer_group, count(*) AS n, avg(x) AS c FROM log_scale GROUP BY 1", ("log_scale",)),
    "spread": (
        """SELECT peer_group, any_value(n) AS n, any_value(c) AS c, avg(abs(x - c)) AS dev, sum((x - c) * (x - c)) AS ss
        FROM log_scale JOIN centres USING (peer_group) GROUP BY 1""",
        ("log_scale", "centres"),
    ),
    # Volume scored against median and MAD, and classically.
    "medians": ("SELECT peer_group, quantile_cont(total, 0.5) AS value_median FROM base GROUP BY 1", ("base",)),
    "mads": (
        """SELECT peer_group, any_value(value_median) AS value_median,
        quantile_cont(abs(total - value_median), 0.5) AS mad FROM base JOIN medians USING (peer_group) GROUP BY 1""",
        ("base", "medians"),
    ),
    "compared": (
        """SELECT b.*, (total - m) / s AS z, 0.6745 * (total - value_median) / greatest(mad, 0.001) AS robust_z
        FROM base b JOIN mads USING (peer_group) JOIN (SELECT peer_group, avg(total) AS m,
        greatest(coalesce(stddev_samp(total), 0), 0.001) AS s FROM base GROUP BY 1) USING (peer_group)""",
        ("base", "mads"),
    ),
    "judged": (
        "SELECT *, abs(z) > 2 AS flag_classic, abs(robust_z) > 3.5 AS flag_robust FROM compared",
        ("compared",),
    ),
    # Percentile limits against the population z-score.
    "limits": (
        """SELECT peer_group, avg(rate) AS m, nullif(stddev_pop(rate), 0) AS s, quantile_cont(rate, 0.95) AS l0,
        quantile_cont(rate, 0.975) AS l1, quantile_cont(rate, 0.99) AS l2 FROM base GROUP BY 1""",
        ("base",),
    ),
    "ruled": (
        """SELECT peer_group, percentile, limit_value, rate > limit_value AS above,
        coalesce((rate - m) / s > 2, false) AS by_z FROM base JOIN
        (SELECT peer_group, m, s, unnest([0.95::DOUBLE, 0.975::DOUBLE, 0.99::DOUBLE]) AS percentile,
        unnest([l0, l1, l2]) AS limit_value FROM limits) USING (peer_group)""",
        ("base", "limits"),
    ),
    "rule_counts": (
        """SELECT peer_group, percentile, any_value(limit_value) AS limit_value, count(*) FILTER (WHERE by_z) AS z_alerts,
        count(*) FILTER (WHERE above) AS percentile_alerts, count(*) FILTER (WHERE above AND by_z) AS shared
        FROM ruled GROUP BY 1, 2""",
        ("ruled",),
    ),
    # Temporal stability.
    "lagged": (
        f"""SELECT entity_id, month, peer_group, lag(peer_group) OVER w AS prev_group, lag(month) OVER w AS prev_month
        FROM base WINDOW w AS (PARTITION BY entity_id ORDER BY month)""",
        ("base",),
    ),
    "moves": (
        f"""SELECT *, CAST(year(month) * 12 + month(month) - year(prev_month) * 12 - month(prev_month) AS INTEGER) AS distance,
        prev_group IS NOT NULL AND coalesce(year(month) * 12 + month(month) - year(prev_month) * 12 - month(prev_month) = 1,
        false) AS comparable FROM lagged""",
        ("lagged",),
    ),
    "flagged_moves": (
        """SELECT *, comparable AND peer_group <> coalesce(prev_group, peer_group) AS changed,
        comparable AND peer_group = coalesce(prev_group, -1) AS stayed FROM moves""",
        ("moves",),
    ),
    "main_groups": (
        """SELECT entity_id, peer_group AS main_group FROM (SELECT entity_id, peer_group,
        row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, peer_group) AS r FROM base GROUP BY 1, 2)
        WHERE r = 1""",
        ("base",),
    ),
    "stable": (
        f"""SELECT entity_id, count(*) AS months_n, count(*) FILTER (WHERE comparable) AS comparisons_n,
        count(*) FILTER (WHERE changed) AS changes_n, count(*) FILTER (WHERE stayed) AS stays_n,
        CAST(count(*) FILTER (WHERE stayed) AS DOUBLE) / nullif(CAST(count(*) FILTER (WHERE comparable) AS DOUBLE), 0) * 100
        AS persistence, any_value(main_group) AS main_group, count(DISTINCT peer_group) AS groups_n
        FROM flagged_moves JOIN main_groups USING (entity_id) GROUP BY 1""",
        ("flagged_moves", "main_groups"),
    ),
    # Isolation forest: sample, growth level by level, scoring of distinct points.
    "size": (
        f"""SELECT n, least(n, {PSI}) AS psi, m0, s0, m1, s1 FROM (SELECT count(*) AS n, avg(log_total) AS m0,
        stddev_pop(log_total) AS s0, avg(rate) AS m1, stddev_pop(rate) AS s1 FROM feat)""",
        ("feat",),
    ),
    "placed": (
        f"""SELECT log_total, rate, row_number() OVER (ORDER BY {_hash('entity_id', _IDX, SEED)}, entity_id, month) - 1 AS place
        FROM feat""",
        ("feat",),
    ),
    # Floyd's sampling: the i-th draw among the first n - psi + i + 1 places; a place drawn before gives the last one.
    "draws": (
        f"""SELECT tree, i, n - psi + i AS j, {_hash('tree', 'i', SEED, 3)} % (n - psi + i + 1) AS r
        FROM size, range({TREES}) t(tree), range({PSI}) u(i) WHERE i < psi""",
        ("size",),
    ),
    "drawn_places": (
        """SELECT tree, unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list([j, r] ORDER BY i)), lambda s, x:
        list_append(s, CASE WHEN list_contains(s, x[2]) THEN x[1] ELSE x[2] END))) AS place FROM draws GROUP BY tree""",
        ("draws",),
    ),
    "grow0": (
        """SELECT tree, 1 AS node, (log_total - m0) / s0 AS x0, (rate - m1) / s1 AS x1
        FROM drawn_places JOIN placed USING (place), size""",
        ("drawn_places", "placed", "size"),
    ),
}

for _level in range(HEIGHT):
    CTES[f"seen{_level}"] = (
        f"""SELECT *, count(*) OVER w AS n, min(x0) OVER w AS a0, max(x0) OVER w AS b0, min(x1) OVER w AS a1,
        max(x1) OVER w AS b1 FROM grow{_level} WINDOW w AS (PARTITION BY tree, node)""",
        (f"grow{_level}",),
    )
    CTES[f"cut{_level}"] = (
        f"""SELECT *, CASE WHEN b0 > a0 AND b1 > a1 THEN {_hash('tree', 'node', SEED, 1)} % 2 WHEN b0 > a0 THEN 0
        WHEN b1 > a1 THEN 1 ELSE -1 END AS feature,
        (CAST({_hash('tree', 'node', SEED, 2)} AS DOUBLE) + 0.5) / {P32}.0::DOUBLE AS u FROM seen{_level}""",
        (f"seen{_level}",),
    )
    CTES[f"split{_level}"] = (
        f"""SELECT *, CASE feature WHEN 0 THEN a0 + u * (b0 - a0) WHEN 1 THEN a1 + u * (b1 - a1) END AS threshold
        FROM cut{_level}""",
        (f"cut{_level}",),
    )
    CTES[f"grow{_level + 1}"] = (
        f"""SELECT tree, CASE WHEN feature >= 0 THEN node * 2 + CAST(CASE feature WHEN 0 THEN x0 ELSE x1 END > threshold
        AS INTEGER) ELSE node END AS node, x0, x1 FROM split{_level}""",
        (f"split{_level}",),
    )

CTES["nodes"] = (
    " UNION ".join(
        [f"SELECT tree, node, feature, threshold, n FROM split{level}" for level in range(HEIGHT)]
        + [f"SELECT tree, node, -1, NULL, count(*) FROM grow{HEIGHT} GROUP BY ALL"]
    ),
    tuple(f"split{level}" for level in range(HEIGHT)) + (f"grow{HEIGHT}",),
)
CTES["points"] = (
    "SELECT DISTINCT log_total, rate, (log_total - m0) / s0 AS x0, (rate - m1) / s1 AS x1 FROM feat, size",
    ("feat", "size"),
)
CTES["walk0"] = (f"SELECT points.*, tree, 1 AS node FROM points, range({TREES}) t(tree)", ("points",))
for _level in range(HEIGHT):
    CTES[f"walk{_level + 1}"] = (
        f"""SELECT log_total, rate, x0, x1, tree, CASE WHEN feature >= 0 THEN w.node * 2 +
        CAST(CASE feature WHEN 0 THEN x0 ELSE x1 END > threshold AS INTEGER) ELSE w.node END AS node
        FROM walk{_level} w JOIN nodes USING (tree, node)""",
        (f"walk{_level}", "nodes"),
    )


def _mean_path(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln({n} - 1) + "
        f"0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1) / {n} END"
    )


CTES["point_scores"] = (
    f"""SELECT log_total, rate, round_even(-pow(2.0::DOUBLE, -(sum(floor(log2(node) + 1e-9) + {_mean_path('nodes.n')}) / {TREES})
    / any_value({_mean_path('psi')})), 12) AS score FROM walk{HEIGHT} JOIN nodes USING (tree, node), size GROUP BY 1, 2""",
    (f"walk{HEIGHT}", "nodes", "size"),
)
CTES["forest_scored"] = (
    "SELECT s.*, score FROM scored s JOIN point_scores USING (log_total, rate)", ("scored", "point_scores"),
)
CTES["detected"] = (
    """SELECT f.*, score - o AS if_decision, o - score AS if_intensity, score - o < 0 AS flag_forest, z > 2 AS flag_z_moderate,
    z > 3 AS flag_z_critical FROM forest_scored f, (SELECT quantile_cont(score, 0.01) AS o FROM forest_scored)""",
    ("forest_scored",),
)
CTES["classified"] = (
    """SELECT *, CASE WHEN flag_z_critical AND flag_forest THEN 'RISCO CRÍTICO' WHEN flag_z_moderate THEN 'ALERTA MODERADO'
    WHEN flag_forest THEN 'ALERTA MULTIVARIADO' ELSE 'NORMAL' END AS status,
    coalesce(nullif(concat_ws(' + ', CASE WHEN flag_z_critical THEN 'Cancelamento muito acima do grupo'
    WHEN flag_z_moderate THEN 'Cancelamento acima do grupo' END,
    CASE WHEN flag_forest THEN 'Anomalia multivariada' END), ''), 'Sem motivo adicional') AS reason,
    greatest(z, 0) + CAST(flag_forest AS INTEGER) AS priority FROM detected""",
    ("detected",),
)
CTES["alerts"] = ("SELECT * FROM classified WHERE status <> 'NORMAL'", ("classified",))
CTES["explained"] = (
    """SELECT *, coalesce(nullif(concat_ws(' | ', CASE
    WHEN flag_z_critical THEN 'Taxa de cancelamento superior a três desvios-padrão em relação ao grupo de porte'
    WHEN flag_z_moderate THEN 'Taxa de cancelamento superior a dois desvios-padrão em relação ao grupo de porte' END,
    CASE WHEN flag_forest THEN 'Combinação entre volume e cancelamento classificada como atípica pelo Isolation Forest' END),
    ''), 'Sem motivo adicional identificado') AS explanation, concat_ws('; ',
    CASE WHEN flag_z_moderate THEN printf('taxa de cancelamento de %.4f%%', round_even(rate * 100, 4)) END,
    CASE WHEN flag_z_moderate THEN printf('média de %.4f%% no Cluster %d', round_even(rate_mean * 100, 4), peer_group) END,
    CASE WHEN flag_z_moderate THEN printf('Z-Score de %.2f', round_even(z, 2)) END,
    CASE WHEN flag_forest THEN
    'combinação entre volume operacional e cancelamento classificada como atípica pelo Isolation Forest' END) AS evidence
    FROM classified""",
    ("classified",),
)
CTES["justified"] = (
    """SELECT *, CASE WHEN evidence = '' THEN 'Registro sem evidência adicional de comportamento atípico.'
    ELSE upper(evidence[1]) || evidence[2:] || '.' END AS justification FROM explained""",
    ("explained",),
)
CTES["ranked"] = (
    """SELECT *, row_number() OVER (ORDER BY priority DESC, if_intensity DESC, entity_id, month) AS position
    FROM justified WHERE status <> 'NORMAL'""",
    ("justified",),
)
CTES["study"] = (
    """SELECT b.*, score, coalesce((rate - m) / nullif(s, 0), 0) AS z FROM base b JOIN point_scores USING (log_total, rate)
    JOIN (SELECT peer_group, avg(rate) AS m, stddev_samp(rate) AS s FROM base GROUP BY 1) USING (peer_group)""",
    ("base", "point_scores"),
)
CTES["sweep"] = (
    """SELECT z > 2 AS by_z, z > 3 AS by_z3, score < o1 AS f1, score < o3 AS f3, score < o5 AS f5 FROM study,
    (SELECT quantile_cont(score, 0.01) AS o1, quantile_cont(score, 0.03) AS o3, quantile_cont(score, 0.05) AS o5
    FROM study)""",
    ("study",),
)
CTES["bands"] = (
    """SELECT CASE WHEN persistence >= 99 THEN 1 WHEN persistence >= 95 THEN 2 WHEN persistence >= 80 THEN 3 ELSE 4 END AS b
    FROM stable WHERE persistence IS NOT NULL""",
    ("stable",),
)
CTES["ends"] = (
    "SELECT min(log_total) AS lo, (max(log_total) - min(log_total)) / 50 AS w FROM feat", ("feat",),
)


def _sql(body: str, *names: str) -> str:
    """The body behind the expressions it names, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dependency in CTES[name][1]:
                visit(dependency)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order) + "\n" + body


def _stack(rows: list[tuple], source: str, columns: tuple[str, ...]) -> str:
    """One SELECT per literal row over a one-row source."""
    return " UNION ALL ".join(
        "SELECT " + ", ".join(f"{value} AS {column}" for value, column in zip(row, columns)) + f" FROM {source}"
        for row in rows
    )


def _kept(column: str) -> str:
    return f"coalesce({column} BETWEEN {START} AND {END}, false)"


_MONTH_COLUMNS = ("entity_id", "month", "total", "cancelled_n", "not_cancelled_n", "null_flag_n")


def _lloyd(iterations: int) -> str:
    steps = [
        """points AS MATERIALIZED (SELECT feat.*, (log_total - m) / s AS x FROM feat,
        (SELECT avg(log_total) AS m, stddev_pop(log_total) AS s FROM feat))""",
        """c0 AS MATERIALIZED (SELECT unnest([quantile_cont(x, 0.125), quantile_cont(x, 0.375), quantile_cont(x, 0.625),
        quantile_cont(x, 0.875)]) AS c FROM points)""",
    ]
    near = "SELECT p.*, (SELECT arg_min(c, abs(p.x - c)) FROM c{i}) AS c FROM points p"
    for i in range(iterations):
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT avg(x) AS c FROM ({near.format(i=i)}) AS q GROUP BY q.c)")
    last = near.format(i=iterations)
    return ", ".join(steps) + f"""
    SELECT CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS peer_group, count(*) AS rows_n, min(total) AS total_min,
    max(total) AS total_max, round_even(avg(log_total), 6) AS centre FROM ({last}) GROUP BY c"""


KMEANS_ITERATIONS = 40  # more than any run on the given tables takes; a run that stopped stays as it is


def _kmeans(ks: tuple[int, ...], restarts: int = 10) -> str:
    """K-Means with restarts up to best(k, cs, cost), as further table expressions after `feat`."""
    sizes = ", ".join(f"({i * restarts + r}, {k})" for i, k in enumerate(ks) for r in range(restarts))
    steps = [
        """hist AS MATERIALIZED (SELECT (v - m) / s AS x, w FROM (SELECT log_total AS v, count(*) AS w FROM feat GROUP BY 1),
        (SELECT avg(log_total) AS m, stddev_pop(log_total) AS s FROM feat))""",
        f"seed0 AS MATERIALIZED (SELECT run, k, CAST([] AS DOUBLE[]) AS cs FROM (VALUES {sizes}) v(run, k))",
    ]
    for i in range(max(ks)):
        gap = "list_min(list_transform(cs, lambda c: (x - c) * (x - c)))" if i else "1.0::DOUBLE"
        u = f"(CAST({_hash('round(x * 1e9)', 'run', i, SEED)} AS DOUBLE) + 0.5) / {P32}.0::DOUBLE"
        steps.append(
            f"""seed{i + 1} AS MATERIALIZED (SELECT run, k, CASE WHEN d IS NULL THEN cs ELSE list_append(cs, d) END AS cs
            FROM seed{i} LEFT JOIN (SELECT run, arg_min(x, -ln(u) / weight) AS d FROM (SELECT run, x, {u} AS u,
            w * {gap} AS weight FROM seed{i}, hist WHERE k > {i}) WHERE weight > 0 GROUP BY 1) USING (run))"""
        )
    steps.append(f"at0 AS MATERIALIZED (SELECT run, k, list_sort(cs) AS cs, true AS active FROM seed{max(ks)})")
    near = """SELECT run, x, w, list_sort(list_transform(cs, lambda c: {{'gap': abs(x - c), 'centre': c}}))[1] AS near
        FROM at{i}, hist"""
    for i in range(KMEANS_ITERATIONS):
        steps.append(
            f"""mean{i} AS MATERIALIZED (SELECT run, near.centre AS c, sum(x * w) / sum(w) AS m
            FROM ({near.format(i=i)} WHERE active) GROUP BY 1, 2)"""
        )
        steps.append(
            f"""move{i} AS MATERIALIZED (SELECT run, list_sort(list(coalesce(m, c))) AS cs_next
            FROM (SELECT run, unnest(cs) AS c FROM at{i} WHERE active) LEFT JOIN mean{i} USING (run, c) GROUP BY 1)"""
        )
        steps.append(
            f"""at{i + 1} AS MATERIALIZED (SELECT run, k, coalesce(cs_next, cs) AS cs, active AND list_sum(list_transform(
            list_zip(cs, cs_next), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) > 1e-4 AS active
            FROM at{i} LEFT JOIN move{i} USING (run))"""
        )
    steps.append(
        f"""costs AS MATERIALIZED (SELECT run, sum(near.gap * near.gap * w) AS cost
        FROM ({near.format(i=KMEANS_ITERATIONS)}) GROUP BY 1)"""
    )
    steps.append(
        f"""best AS MATERIALIZED (SELECT k, cs, cost FROM at{KMEANS_ITERATIONS} JOIN costs USING (run)
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(cost, 6), run) = 1)"""
    )
    return ",\n".join(steps)


def _band(x: str) -> str:
    """Group of x among ascending centres: midpoints below it."""
    return f"CAST(len(list_filter(list_zip(cs[:-2], cs[2:]), lambda p: {x} > (p[1] + p[2]) / 2)) AS INTEGER)"


def _titled(report: str) -> str:
    return ", ".join(f'{column} AS "{title}"' for column, title in HEADINGS[report].items())


def oracle_sql() -> dict[str, str]:
    months = ", ".join(_MONTH_COLUMNS)
    out = {
        "monthly_fact": _sql(f"SELECT {months} FROM months", "months"),
        "stage_roundtrip": _sql(f"SELECT {months} FROM months", "months"),
        "coerce_dates": _sql(f"SELECT {months} FROM bad_months", "bad_months"),
        "coerce_numeric": """SELECT entity_id, count(*) AS rows_n, count(*) FILTER (WHERE quantity IS NULL) AS invalid_n,
            round_even(sum(quantity), 6) AS quantity FROM (SELECT l_suppkey AS entity_id, TRY_CAST(CASE WHEN l_linenumber = 7
            THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE) AS quantity FROM lineitem) GROUP BY 1""",
        "period_cut": _sql(f"SELECT {months} FROM kept", "kept"),
        "removed_rows": _sql(f"SELECT {months}, reason FROM bad_reasons WHERE reason IS NOT NULL", "bad_reasons"),
        "removal_reasons": _sql(
            """SELECT CAST(i AS INTEGER) AS position, name AS reason, (SELECT count(*) FROM bad_reasons b WHERE b.reason = name)
            AS rows_n FROM (VALUES (1, 'Datas inválidas'), (2, 'Antes de 1996'), (3, 'Após junho de 2001')) v(i, name)""",
            "bad_reasons",
        ),
        "before_after_by_year": _sql(
            f"""SELECT CAST(y AS INTEGER) AS year, before_n, after_n, before_n - after_n AS removed_n,
            {_pct('before_n - after_n', 'before_n')} AS removed_pct FROM (SELECT year(month) AS y, count(*) AS before_n,
            count(*) FILTER (WHERE {_kept('month')}) AS after_n FROM months GROUP BY 1)""",
            "months",
        ),
        "before_after_by_entity": _sql("SELECT * FROM oshare", "oshare"),
        "before_after_joined": _sql(
            f"""SELECT CAST(coalesce(a.y, b.y) AS INTEGER) AS year, coalesce(x, 0) AS before_n, coalesce(k, 0) AS after_n,
            coalesce(x, 0) - coalesce(k, 0) AS removed_n, {_pct('coalesce(x, 0) - coalesce(k, 0)', 'coalesce(x, 0)')} AS removed_pct
            FROM (SELECT year(month) AS y, count(*) AS x FROM omonths GROUP BY 1) a FULL JOIN (SELECT year(month) AS y,
            count(*) AS k FROM omonths WHERE month BETWEEN {O_START} AND {O_END} GROUP BY 1) b ON a.y = b.y""",
            "omonths",
        ),
        "null_counts": _sql(
            _stack(
                [(f"CAST({i} AS INTEGER)", f"'{c}'", f"count(*) FILTER (WHERE {c} IS NULL)") for i, c in enumerate(_MONTH_COLUMNS, 1)],
                "bad_months",
                ("position", "column_name", "nulls_n"),
            ),
            "bad_months",
        ),
        "duplicate_keys": """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates_n, count(*) AS keys_n FROM
            (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
        "validation_report": _sql(
            """SELECT CAST(i AS INTEGER) AS position, rule, CAST(v AS BIGINT) AS violations, v = 0 AS passed FROM
            (SELECT 1 AS i, 'missing_columns' AS rule, 1 AS v
            UNION ALL SELECT 2, 'empty', CAST(count(*) = 0 AS INTEGER) FROM base
            UNION ALL SELECT 3, 'nulls', count(*) FILTER (WHERE entity_id IS NULL) + count(*) FILTER (WHERE month IS NULL)
              + count(*) FILTER (WHERE rate IS NULL) + count(*) FILTER (WHERE log_total IS NULL) FROM base
            UNION ALL SELECT 4, 'infinite', count(*) FILTER (WHERE isinf(rate) OR isinf(log_total)) FROM base
            UNION ALL SELECT 5, 'duplicate_keys', count(*) - count(DISTINCT (entity_id, month)) FROM base
            UNION ALL SELECT 6, 'small_groups', count(*) FILTER (WHERE group_n < 30) FROM stats)""",
            "base", "stats",
        ),
        "quality_report": _sql(
            f"""SELECT count(*) AS rows_in, count(*) FILTER (WHERE k) AS rows_kept, count(*) FILTER (WHERE NOT k) AS rows_removed,
            count(*) FILTER (WHERE month IS NULL) AS invalid_n, count(*) FILTER (WHERE month < {START}) AS before_n,
            count(*) FILTER (WHERE month > {END}) AS after_n, min(month) FILTER (WHERE k) AS first_month,
            max(month) FILTER (WHERE k) AS last_month, CAST(sum(null_flag_n) FILTER (WHERE k) AS BIGINT) AS null_flag_n,
            CAST(sum(not_cancelled_n) FILTER (WHERE k) AS BIGINT) AS not_cancelled_n,
            CAST(sum(cancelled_n) FILTER (WHERE k) AS BIGINT) AS cancelled_n
            FROM (SELECT *, {_kept('month')} AS k FROM bad_months)""",
            "bad_months",
        ),
        "flag_diagnostics": _sql(
            f"""SELECT CAST(year(month) AS INTEGER) AS year, CAST(sum(total) AS BIGINT) AS total, CAST(sum(cancelled_n) AS BIGINT)
            AS cancelled_n, CAST(sum(not_cancelled_n) AS BIGINT) AS not_cancelled_n, CAST(sum(null_flag_n) AS BIGINT)
            AS null_flag_n, {_pct('sum(null_flag_n)', 'sum(total)')} AS null_flag_pct FROM kept GROUP BY 1""",
            "kept",
        ),
        "general_stats": _sql(
            "SELECT * FROM (" + _stack(
                [
                    ("CAST(1 AS INTEGER)", "'Registros Originais'", "CAST(a AS DOUBLE)"),
                    ("CAST(2 AS INTEGER)", "'Registros Após Limpeza'", "CAST(b AS DOUBLE)"),
                    ("CAST(3 AS INTEGER)", "'Removidos'", "CAST(a - b AS DOUBLE)"),
                    ("CAST(4 AS INTEGER)", "'% Removido'", _pct("a - b", "a")),
                ],
                f"(SELECT count(*) AS a, count(*) FILTER (WHERE {_kept('month')}) AS b FROM months)",
                ("position", "indicator", "value"),
            ) + ")",
            "months",
        ),
        "period_bounds": _sql(
            """SELECT CAST(1 AS INTEGER) AS position, 'Data mínima' AS indicator, min(month) AS value FROM kept
            UNION ALL SELECT 2, 'Data máxima', max(month) FROM kept""",
            "kept",
        ),
        "removal_stats": _sql(
            "SELECT * FROM (" + _stack(
                [
                    (f"CAST({i} AS INTEGER)", f"'{title}'", value)
                    for i, (title, value) in enumerate(
                        [
                            ("Serventias na base original", "CAST(count(*) AS DOUBLE)"),
                            ("Serventias na base analítica", "CAST(count(*) FILTER (WHERE after_n > 0) AS DOUBLE)"),
                            ("Serventias excluídas integralmente", "CAST(count(*) FILTER (WHERE after_n = 0) AS DOUBLE)"),
                            ("Média (%) de registros removidos", "round_even(avg(p), 2)"),
                            ("Mediana (%)", "round_even(quantile_cont(p, 0.5), 2)"),
                            ("Desvio padrão (%)", "round_even(stddev_samp(p), 2)"),
                            ("Mínimo (%)", "min(p)"),
                            ("Máximo (%)", "max(p)"),
                        ],
                        1,
                    )
                ],
                "(SELECT *, CASE WHEN after_n > 0 THEN removed_pct END AS p FROM oshare)",
                ("position", "indicator", "value"),
            ) + ")",
            "oshare",
        ),
        "excluded_entities": _sql("SELECT * FROM oshare WHERE after_n = 0", "oshare"),
        "excluded_entity_years": _sql(
            """SELECT entity_id, CAST(year(month) AS INTEGER) AS year, count(*) AS rows_n FROM omonths
            WHERE entity_id IN (SELECT entity_id FROM oentities WHERE after_n = 0) AND month IS NOT NULL GROUP BY 1, 2""",
            "omonths", "oentities",
        ),
        "features": _sql(f"SELECT {months}, {_r('rate', 'log_total')} FROM feat", "feat"),
        "standardise": _sql(
            """SELECT entity_id, month, round_even((log_total - m0) / s0, 6) AS log_total_std,
            round_even((rate - m1) / s1, 6) AS rate_std FROM feat, size""",
            "feat", "size",
        ),
        "calendar_parts": _sql(
            f"""SELECT entity_id, month, CAST(year(month) AS INTEGER) AS year, CAST({_IDX} AS INTEGER) AS month_idx,
            strftime(month, '%m/%Y') AS month_label FROM months""",
            "months",
        ),
        "peer_gap": _sql(f"SELECT entity_id, month, peer_group, {_r('gap_pp', 'ratio')} FROM scored", "scored"),
        "label_groups": _sql(
            """SELECT entity_id, month, peer_group, CASE peer_group WHEN 0 THEN 'Muito pequeno porte' WHEN 1 THEN 'Pequeno porte'
            WHEN 2 THEN 'Médio porte' WHEN 3 THEN 'Grande porte' END AS peer_name FROM base""",
            "base",
        ),
        "peer_lloyd": _sql("", "feat").rstrip() + ", " + _lloyd(5),
        "relabel_groups": _sql(
            """SELECT entity_id, month, raw_group, CAST(g AS INTEGER) AS peer_group FROM
            (SELECT *, CAST((peer_group * 3 + 2) % 4 AS INTEGER) AS raw_group FROM base) JOIN
            (SELECT (peer_group * 3 + 2) % 4 AS raw_group, row_number() OVER (ORDER BY avg(log_total)) - 1 AS g FROM base GROUP BY 1)
            USING (raw_group)""",
            "base",
        ),
        "cluster_inertia": _sql(
            "SELECT CAST(sum(n) AS BIGINT) AS n, round_even(sum(ss), 6) AS inertia FROM spread", "spread"
        ),
        "silhouette": _sql(
            """, spots AS MATERIALIZED (SELECT peer_group, x, count(*) AS w FROM log_scale GROUP BY 1, 2),
            pairs AS MATERIALIZED (SELECT p.peer_group AS g, p.x AS x, any_value(p.w) AS w, q.peer_group AS o,
            sum(q.w * abs(p.x - q.x)) AS d, sum(q.w) AS n FROM spots p, spots q GROUP BY 1, 2, 4),
            ab AS MATERIALIZED (SELECT g, x, any_value(w) AS w, max(CASE WHEN o = g THEN d / nullif(n - 1, 0) END) AS a,
            min(CASE WHEN o <> g THEN d / n END) AS b FROM pairs GROUP BY 1, 2)
            SELECT round_even(sum(w * coalesce((b - a) / nullif(greatest(a, b), 0), 0)) / sum(w), 6) AS silhouette FROM ab""",
            "log_scale",
        ),
        "davies_bouldin": _sql(
            """SELECT round_even(avg(m), 6) AS davies_bouldin FROM (SELECT max((p.dev + q.dev) / abs(p.c - q.c)) AS m
            FROM spread p, spread q WHERE p.peer_group <> q.peer_group GROUP BY p.peer_group)""",
            "spread",
        ),
        "calinski_harabasz": _sql(
            """SELECT round_even(sum(n * (c - m) * (c - m)) * (sum(n) - count(*)) / (sum(ss) * (count(*) - 1)), 4)
            AS calinski_harabasz FROM spread, (SELECT sum(n * c) / sum(n) AS m FROM spread)""",
            "spread",
        ),
        "cluster_sizes": _sql(
            """SELECT peer_group, group_n AS rows_n, min(group_n) OVER () AS smallest, max(group_n) OVER () AS largest
            FROM stats""",
            "stats",
        ),
        "cluster_profile": _sql(
            f"""SELECT peer_group, count(*) AS rows_n, count(DISTINCT entity_id) AS entities_n, min(total) AS total_min,
            round_even(avg(total), 2) AS total_mean, round_even(CAST(quantile_cont(total, 0.5) AS DOUBLE), 2) AS total_median,
            max(total) AS total_max, round_even(avg(rate) * 100, 4) AS rate_mean_pct,
            round_even(quantile_cont(rate, 0.5) * 100, 4) AS rate_median_pct,
            {_pct('count(*)', '(SELECT count(*) FROM base)')} AS base_pct FROM base GROUP BY 1""",
            "base",
        ),
        "cluster_by_year": _sql(
            "SELECT CAST(year(month) AS INTEGER) AS year, peer_group, count(*) AS rows_n FROM base GROUP BY 1, 2", "base"
        ),
        "cluster_rules": _sql(
            f"""SELECT peer_group, rows_n, {_pct('rows_n', 'sum(rows_n) OVER ()')} AS base_pct, entities_n,
            CAST(round_even(t, 0) AS BIGINT) AS total_mean, round_even(r * 100, 2) AS rate_mean_pct,
            round_even(s * 100, 2) AS missing_mean_pct, CASE WHEN r >= 0.3 THEN 'Alta taxa de cancelamento'
            WHEN t >= 30000 THEN 'Alto volume operacional' WHEN s >= 0.9 THEN 'Alta incidência de selos sem guia'
            ELSE 'Baixa incidência de selos sem guia' END AS profile FROM (SELECT peer_group, count(*) AS rows_n,
            count(DISTINCT entity_id) AS entities_n, avg(total) AS t, avg(rate) AS r,
            avg(null_flag_n / CAST(greatest(total, 1) AS DOUBLE)) AS s FROM base GROUP BY 1)""",
            "base",
        ),
        "peer_stats": _sql(
            f"""SELECT peer_group, group_n, {_r('rate_mean', 'rate_median', 'rate_std', 'rate_p90', 'total_mean', 'total_median')}
            FROM stats""",
            "stats",
        ),
        "zscore_peer": _sql(
            f"SELECT entity_id, month, peer_group, {_r('rate', 'rate_mean', 'rate_std', 'z')} FROM scored", "scored"
        ),
        "zscore_pop": _sql(
            """SELECT entity_id, month, peer_group, round_even((rate - m) / s, 6) AS z_pop FROM base JOIN limits
            USING (peer_group)""",
            "base", "limits",
        ),
        "z_flags": _sql(
            """SELECT entity_id, month, z > 2 AS flag_z_moderate, z > 3 AS flag_z_critical, abs(z) > 2 AS flag_two_sided
            FROM scored""",
            "scored",
        ),
        "mad_by_group": _sql(
            "SELECT peer_group, CAST(value_median AS DOUBLE) AS value_median, CAST(mad AS DOUBLE) AS mad FROM mads", "mads"
        ),
        "mad_diagnostics": _sql(
            f"""SELECT peer_group, count(*) AS rows_n, round_even(any_value(md), 6) AS value_median,
            round_even(quantile_cont(abs(rate - md), 0.5), 6) AS mad, round_even(min(rate), 6) AS value_min,
            round_even(max(rate), 6) AS value_max, round_even(avg(CAST(rate = 0 AS INTEGER)) * 100, 6) AS zero_pct,
            quantile_cont(abs(rate - md), 0.5) = 0 AS mad_zero FROM base JOIN (SELECT peer_group, quantile_cont(rate, 0.5) AS md
            FROM base GROUP BY 1) USING (peer_group) GROUP BY 1""",
            "base",
        ),
        "robust_zscore": _sql(
            f"SELECT entity_id, month, peer_group, total, {_r('robust_z')}, flag_robust FROM judged", "judged"
        ),
        "direction": _sql(
            """SELECT entity_id, month, CASE WHEN z > 0 THEN 'Acima do grupo' WHEN z < 0 THEN 'Abaixo do grupo'
            ELSE 'Igual ao centro do grupo' END AS direction_classic, CASE WHEN robust_z > 0 THEN 'Acima do grupo'
            WHEN robust_z < 0 THEN 'Abaixo do grupo' ELSE 'Igual ao centro do grupo' END AS direction_robust FROM compared""",
            "compared",
        ),
        "percentile_rule": _sql(
            """SELECT entity_id, month, round_even(l0, 6) AS limit_0, round_even(l1, 6) AS limit_1, round_even(l2, 6) AS limit_2,
            rate > l0 AS above_0, rate > l1 AS above_1, rate > l2 AS above_2 FROM base JOIN limits USING (peer_group)""",
            "base", "limits",
        ),
        "iforest_fit": _sql(
            f"""SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature,
            {_r('threshold')}, CAST(n AS INTEGER) AS n FROM nodes""",
            "nodes",
        ),
        "iforest_score": _sql(f"SELECT entity_id, month, {_r('score')} FROM feat JOIN point_scores USING (log_total, rate)", "feat", "point_scores"),
        "iforest_boxes": _sql(
            f"""SELECT entity_id, month, {_r('score')} FROM feat JOIN (SELECT log_total, rate,
            -pow(2.0::DOUBLE, -(sum(d + {_mean_path('n')}) / 2) / {_mean_path('8')}) AS score
            FROM (SELECT DISTINCT log_total, rate FROM feat) p JOIN (VALUES
            (2, '-inf'::DOUBLE, 2.0, '-inf'::DOUBLE, 0.3, 1), (2, '-inf'::DOUBLE, 2.0, 0.3, 'inf'::DOUBLE, 2), (2, 2.5, 'inf'::DOUBLE, '-inf'::DOUBLE, 'inf'::DOUBLE, 1),
            (3, 2.0, 2.5, '-inf'::DOUBLE, 0.5, 3), (3, 2.0, 2.5, 0.5, 'inf'::DOUBLE, 1),
            (1, '-inf'::DOUBLE, 'inf'::DOUBLE, '-inf'::DOUBLE, 0.4, 5), (2, '-inf'::DOUBLE, 1.5, 0.4, 'inf'::DOUBLE, 1), (2, 1.5, 'inf'::DOUBLE, 0.4, 'inf'::DOUBLE, 2)
            ) b(d, l0, h0, l1, h1, n) ON log_total > l0 AND log_total <= h0 AND rate > l1 AND rate <= h1
            GROUP BY ALL) USING (log_total, rate)""",
            "feat",
        ),
        "iforest_score_boxes": _sql(f"SELECT entity_id, month, {_r('score')} FROM feat JOIN point_scores USING (log_total, rate)", "feat", "point_scores"),
        "iforest_threshold": _sql(
            f"""SELECT entity_id, month, {_r('if_decision')}, CAST(CASE WHEN flag_forest THEN -1 ELSE 1 END AS INTEGER)
            AS if_label, {_r('if_intensity')}, flag_forest FROM detected""",
            "detected",
        ),
        "selectivity": _sql(
            f"""SELECT *, {_pct('global_n - contextual_n', 'global_n')} AS reduction_pct FROM (SELECT count(*) AS base_n,
            count(*) FILTER (WHERE (rate - m) / s > 2) AS global_n, count(*) FILTER (WHERE status <> 'NORMAL') AS contextual_n
            FROM classified, (SELECT avg(rate) AS m, stddev_samp(rate) AS s FROM base))""",
            "classified",
        ),
        "triage_status": _sql("SELECT entity_id, month, status FROM classified", "classified"),
        "reason_category": _sql("SELECT entity_id, month, reason FROM classified", "classified"),
        "explanation": _sql("SELECT entity_id, month, explanation FROM explained", "explained"),
        "justification": _sql("SELECT entity_id, month, justification FROM justified", "justified"),
        "priority_score": _sql(f"SELECT entity_id, month, {_r('priority')} FROM classified", "classified"),
        "ranked_alerts": _sql(
            f"SELECT position, entity_id, month, status, {_r('priority', 'if_intensity')} FROM ranked", "ranked"
        ),
        "status_distribution": _sql(
            f"""SELECT status, count(*) AS alerts_n, {_pct('count(*)', '(SELECT count(*) FROM alerts)')} AS alerts_pct,
            {_pct('count(*)', '(SELECT count(*) FROM classified)')} AS base_pct FROM alerts GROUP BY 1""",
            "alerts",
        ),
        "reason_distribution": _sql(
            f"""SELECT reason, count(*) AS alerts_n, {_pct('count(*)', '(SELECT count(*) FROM alerts)')} AS alerts_pct
            FROM alerts GROUP BY 1""",
            "alerts",
        ),
        "top_alerts": _sql(
            f"""SELECT CAST(position AS INTEGER) AS position, entity_id, month, strftime(month, '%m/%Y') AS month_label, peer_group,
            total, cancelled_n, {_r('rate', 'rate_mean')}, round_even(z, 2) AS z, CAST(CASE WHEN flag_forest THEN -1 ELSE 1 END
            AS INTEGER) AS if_label, {_r('if_intensity')}, round_even(priority, 2) AS priority, status, reason, justification
            FROM ranked WHERE position <= 20""",
            "ranked",
        ),
        "peer_stats_report": _sql(
            f"""SELECT peer_group, group_n, {_r('rate_mean', 'rate_median', 'rate_std', 'rate_p90', 'total_mean', 'total_median')},
            round_even(rate_mean * 100, 6) AS rate_mean_pct, round_even(rate_median * 100, 6) AS rate_median_pct,
            round_even(rate_std * 100, 6) AS rate_std_pct, round_even(rate_p90 * 100, 6) AS rate_p90_pct FROM stats""",
            "stats",
        ),
        "describe_columns": _sql(
            "SELECT * FROM (" + " UNION ALL ".join(
                f"SELECT CAST({i} AS INTEGER) AS position, '{stat}' AS statistic, "
                + ", ".join(f"round_even(CAST({expr.format(c=c)} AS DOUBLE), 6) AS {c}" for c in ("total", "log_total", "rate"))
                + " FROM feat"
                for i, (stat, expr) in enumerate(
                    [
                        ("count", "count({c})"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"),
                        ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
                        ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})"),
                    ],
                    1,
                )
            ) + ")",
            "feat",
        ),
        "percentile_vs_z": _sql(
            f"""SELECT peer_group, percentile, {_r('limit_value')}, z_alerts, percentile_alerts, shared,
            round_even(coalesce({_pct('shared', 'z_alerts', None)}, 0), 6) AS z_kept_pct FROM rule_counts""",
            "rule_counts",
        ),
        "percentile_vs_z_global": _sql(
            f"""SELECT *, round_even(coalesce({_pct('shared', 'z_alerts', None)}, 0), 6) AS z_kept_pct FROM (SELECT percentile,
            CAST(sum(z_alerts) AS BIGINT) AS z_alerts, CAST(sum(percentile_alerts) AS BIGINT) AS percentile_alerts,
            CAST(sum(shared) AS BIGINT) AS shared FROM rule_counts GROUP BY 1)""",
            "rule_counts",
        ),
        "contamination_sweep": _sql(
            " UNION ALL ".join(
                f"""SELECT CAST({c} AS INTEGER) AS contamination_pct, count(*) FILTER (WHERE f{c}) AS forest_n,
                {_pct(f'count(*) FILTER (WHERE f{c})', 'count(*)')} AS forest_pct,
                count(*) FILTER (WHERE by_z OR f{c}) AS hybrid_n,
                {_pct(f'count(*) FILTER (WHERE by_z OR f{c})', 'count(*)')} AS hybrid_pct,
                count(*) FILTER (WHERE by_z3 AND f{c}) AS critical_n,
                {_pct(f'count(*) FILTER (WHERE by_z3 AND f{c})', 'count(*)', 4)} AS critical_pct,
                count(*) FILTER (WHERE by_z AND f{c}) AS both_n, count(*) FILTER (WHERE NOT by_z AND f{c}) AS only_forest_n,
                count(*) FILTER (WHERE by_z AND NOT f{c}) AS only_z_n FROM sweep"""
                for c in (1, 3, 5)
            ),
            "sweep",
        ),
        "contamination_overlap": _sql(
            " UNION ALL ".join(
                f"""SELECT CAST({c} AS INTEGER) AS contamination_pct, count(*) FILTER (WHERE f{c} AND f1) AS forest_shared,
                count(*) FILTER (WHERE f{c} AND NOT f1) AS forest_new,
                count(*) FILTER (WHERE (f{c} OR by_z) AND (f1 OR by_z)) AS hybrid_shared,
                count(*) FILTER (WHERE (f{c} OR by_z) AND NOT (f1 OR by_z)) AS hybrid_new FROM sweep"""
                for c in (3, 5)
            ),
            "sweep",
        ),
        "method_comparison": _sql(
            f"""SELECT CAST(1 AS INTEGER) AS position, 'Z-Score tradicional' AS method, '|Z| > 2.0' AS limit_text,
            count(*) FILTER (WHERE flag_classic) AS alerts_n, {_pct('count(*) FILTER (WHERE flag_classic)', 'count(*)')} AS base_pct
            FROM judged UNION ALL SELECT 2, 'Robust Z-Score', '|RZ| > 3.5', count(*) FILTER (WHERE flag_robust),
            {_pct('count(*) FILTER (WHERE flag_robust)', 'count(*)')} FROM judged""",
            "judged",
        ),
        "method_overlap": _sql(
            " UNION ALL ".join(
                f"""SELECT CAST({i} AS INTEGER) AS position, '{title}' AS situation, count(*) FILTER (WHERE {rule}) AS rows_n,
                {_pct(f'count(*) FILTER (WHERE {rule})', 'count(*)')} AS base_pct FROM judged"""
                for i, (title, rule) in enumerate(
                    [
                        ("Alertas identificados pelos dois métodos", "flag_classic AND flag_robust"),
                        ("Somente Z-Score tradicional", "flag_classic AND NOT flag_robust"),
                        ("Somente Robust Z-Score", "flag_robust AND NOT flag_classic"),
                        ("Não identificados por nenhum método", "NOT flag_classic AND NOT flag_robust"),
                    ],
                    1,
                )
            ),
            "judged",
        ),
        "method_by_cluster": _sql(
            f"""SELECT peer_group, count(*) AS rows_n, count(*) FILTER (WHERE flag_classic) AS classic_n,
            count(*) FILTER (WHERE flag_robust) AS robust_n, count(*) FILTER (WHERE flag_classic AND flag_robust) AS both_n,
            count(*) FILTER (WHERE flag_classic AND NOT flag_robust) AS only_classic_n,
            count(*) FILTER (WHERE flag_robust AND NOT flag_classic) AS only_robust_n,
            {_pct('count(*) FILTER (WHERE flag_classic)', 'count(*)')} AS classic_pct,
            {_pct('count(*) FILTER (WHERE flag_robust)', 'count(*)')} AS robust_pct FROM judged GROUP BY 1""",
            "judged",
        ),
        "spearman": _sql(
            """SELECT count(*) AS n, round_even(corr(ra, rb), 6) AS rho FROM (SELECT
            rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS ra,
            rank() OVER (ORDER BY robust_z) + (count(*) OVER (PARTITION BY robust_z) - 1) / 2.0::DOUBLE AS rb FROM compared)""",
            "compared",
        ),
        "peer_transitions": _sql(
            """SELECT entity_id, month, peer_group, prev_group, prev_month, distance, comparable, changed, stayed
            FROM flagged_moves""",
            "flagged_moves",
        ),
        "entity_stability": _sql(
            f"""SELECT entity_id, months_n, comparisons_n, changes_n, stays_n, {_r('persistence')}, main_group, groups_n
            FROM stable""",
            "stable",
        ),
        "persistence_bands": _sql(
            """SELECT CAST(i AS INTEGER) AS position, name AS band, coalesce(n, 0) AS entities_n,
            CASE WHEN i = 5 THEN 100.0::DOUBLE ELSE """ + _pct("coalesce(n, 0)", "(SELECT count(*) FROM bands)") + """ END
            AS entities_pct FROM (VALUES (1, 'Muito alta (≥ 99%)'), (2, 'Alta (95% a 98,99%)'), (3, 'Moderada (80% a 94,99%)'),
            (4, 'Baixa (< 80%)'), (5, 'Total')) v(i, name) LEFT JOIN (SELECT b, count(*) AS n FROM bands GROUP BY 1 UNION ALL
            SELECT 5, count(*) FROM bands) ON b = i""",
            "bands",
        ),
        "persistence_summary": _sql(
            "SELECT * FROM (" + _stack(
                [
                    (f"CAST({i} AS INTEGER)", f"'{title}'", value)
                    for i, (title, value) in enumerate(
                        [
                            ("Total de serventias", "CAST(count(*) AS DOUBLE)"),
                            ("Serventias com comparações consecutivas", "CAST(count(persistence) AS DOUBLE)"),
                            ("Serventias sem comparação consecutiva", "CAST(count(*) - count(persistence) AS DOUBLE)"),
                            ("Serventias sem mudança", "CAST(count(*) FILTER (WHERE c = 0) AS DOUBLE)"),
                            ("Serventias com uma mudança", "CAST(count(*) FILTER (WHERE c = 1) AS DOUBLE)"),
                            ("Serventias com duas mudanças", "CAST(count(*) FILTER (WHERE c = 2) AS DOUBLE)"),
                            ("Serventias com três ou mais mudanças", "CAST(count(*) FILTER (WHERE c >= 3) AS DOUBLE)"),
                            ("Serventias com alguma mudança", "CAST(count(*) FILTER (WHERE c > 0) AS DOUBLE)"),
                            ("Persistência temporal média (%)", "round_even(avg(persistence), 2)"),
                            ("Persistência temporal mediana (%)", "round_even(quantile_cont(persistence, 0.5), 2)"),
                            ("Menor persistência temporal (%)", "round_even(min(persistence), 2)"),
                            ("Maior persistência temporal (%)", "round_even(max(persistence), 2)"),
                            ("Média de mudanças por serventia", "round_even(avg(c), 2)"),
                            ("Mediana de mudanças por serventia", "round_even(CAST(quantile_cont(c, 0.5) AS DOUBLE), 2)"),
                            ("Maior número de mudanças", "CAST(max(c) AS DOUBLE)"),
                        ],
                        1,
                    )
                ],
                "(SELECT *, CASE WHEN persistence IS NOT NULL THEN changes_n END AS c FROM stable)",
                ("position", "indicator", "value"),
            ) + ")",
            "stable",
        ),
        "transition_matrix": _sql(
            """SELECT prev_group AS origin, peer_group AS destination, count(*) AS rows_n FROM flagged_moves WHERE changed
            GROUP BY 1, 2""",
            "flagged_moves",
        ),
        "least_stable": _sql(
            f"""SELECT entity_id, months_n, comparisons_n, changes_n, stays_n, {_r('persistence')}, main_group, groups_n FROM
            (SELECT * FROM stable WHERE persistence IS NOT NULL ORDER BY persistence, changes_n DESC, entity_id LIMIT 20)""",
            "stable",
        ),
        "histogram": _sql(
            """SELECT i AS bin, round_even(lo + i * w, 6) AS bin_start, round_even(lo + (i + 1) * w, 6) AS bin_end,
            coalesce(n, 0) AS rows_n FROM range(50) r(i), ends LEFT JOIN (SELECT CAST(least(floor((log_total - lo) / w), 49) AS
            BIGINT) AS b, count(*) AS n FROM feat, ends GROUP BY 1) ON b = i""",
            "feat", "ends",
        ),
        "persistence_histogram": _sql(
            """SELECT i AS bin, CAST(i * 5 AS DOUBLE) AS bin_start, CAST(i * 5 + 5 AS DOUBLE) AS bin_end, coalesce(n, 0) AS rows_n
            FROM range(20) r(i) LEFT JOIN (SELECT CAST(least(floor(persistence / 5), 19) AS BIGINT) AS b, count(*) AS n
            FROM stable WHERE persistence IS NOT NULL GROUP BY 1) ON b = i""",
            "stable",
        ),
        "box_stats": _sql(
            """SELECT peer_group, count(*) AS rows_n, round_even(any_value(q1), 6) AS q1, round_even(any_value(q2), 6) AS median,
            round_even(any_value(q3), 6) AS q3,
            round_even(min(log_total) FILTER (WHERE log_total BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
            round_even(max(log_total) FILTER (WHERE log_total BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
            count(*) FILTER (WHERE log_total NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers_n
            FROM base JOIN (SELECT peer_group, quantile_cont(log_total, 0.25) AS q1, quantile_cont(log_total, 0.5) AS q2,
            quantile_cont(log_total, 0.75) AS q3 FROM base GROUP BY 1) USING (peer_group) GROUP BY 1""",
            "base",
        ),
        "trim_p99": _sql(
            """SELECT entity_id, month, round_even(rate, 6) AS rate FROM feat WHERE rate <=
            (SELECT CASE WHEN quantile_cont(rate, 0.99) > 0 THEN quantile_cont(rate, 0.99) ELSE max(rate) END FROM feat)""",
            "feat",
        ),
        "clip_p995": _sql(
            """SELECT entity_id, month, round_even(rate, 6) AS rate, round_even(least(rate, p), 6) AS clipped FROM feat,
            (SELECT CASE WHEN quantile_cont(rate, 0.995) > 0 THEN quantile_cont(rate, 0.995) ELSE max(rate) END AS p FROM feat)""",
            "feat",
        ),
        "sample_rows": _sql(
            f"""SELECT entity_id, month, {_r('log_total', 'rate')} FROM (SELECT * FROM feat
            ORDER BY {_hash('entity_id', _IDX, SEED)}, entity_id, month LIMIT 15000)""",
            "feat",
        ),
        "flag_series": _sql(
            f"""SELECT CAST(year(month) AS INTEGER) AS year, {_pct('sum(null_flag_n)', 'sum(total)')} AS null_flag_pct FROM kept
            WHERE year(month) BETWEEN 1997 AND 2000 GROUP BY 1""",
            "kept",
        ),
        "monthly_series": _sql("SELECT month, CAST(sum(total) AS BIGINT) AS total FROM kept GROUP BY 1", "kept"),
        "status_counts": _sql(
            """SELECT CAST(i AS INTEGER) AS position, name AS status, (SELECT count(*) FROM alerts a WHERE a.status = name) AS alerts_n
            FROM (VALUES (1, 'RISCO CRÍTICO'), (2, 'ALERTA MODERADO'), (3, 'ALERTA MULTIVARIADO')) v(i, name)""",
            "alerts",
        ),
        "top_labelled": _sql(
            f"""SELECT CAST(position AS INTEGER) AS position, 'Serventia ' || entity_id || ' | ' || strftime(month, '%m/%Y')
            AS case_label, {_r('priority')}, status FROM ranked WHERE position <= 20""",
            "ranked",
        ),
        "alerts_crosstab": _sql(
            """SELECT peer_group, count(*) FILTER (WHERE status = 'RISCO CRÍTICO') AS "RISCO CRÍTICO",
            count(*) FILTER (WHERE status = 'ALERTA MODERADO') AS "ALERTA MODERADO",
            count(*) FILTER (WHERE status = 'ALERTA MULTIVARIADO') AS "ALERTA MULTIVARIADO" FROM alerts GROUP BY 1""",
            "alerts",
        ),
        "alerts_by_year": _sql(
            "SELECT CAST(year(month) AS INTEGER) AS year, status, count(*) AS alerts_n FROM alerts GROUP BY 1, 2", "alerts"
        ),
    }
    scale = "(SELECT avg(log_total) AS m, stddev_pop(log_total) AS s FROM feat)"
    out["peer_kmeans"] = _sql("", "feat").rstrip() + ", " + _kmeans((4,)) + f"""
        SELECT peer_group, count(*) AS rows_n, min(total) AS total_min, max(total) AS total_max,
        round_even(avg(log_total), 6) AS centre FROM (SELECT feat.*, {_band('((log_total - m) / s)')} AS peer_group
        FROM feat, best, {scale}) GROUP BY 1"""
    out["k_sweep"] = _sql("", "feat").rstrip() + ", " + _kmeans((2, 3, 4, 5, 6)) + f""",
        spots AS MATERIALIZED (SELECT k, {_band('x')} AS g, x, w FROM hist, best),
        middles AS MATERIALIZED (SELECT k, g, sum(w) AS n, sum(x * w) / sum(w) AS c FROM spots GROUP BY 1, 2),
        spreads AS MATERIALIZED (SELECT k, g, any_value(n) AS n, any_value(c) AS c, sum(w * abs(x - c)) / any_value(n) AS dev,
        sum(w * (x - c) * (x - c)) AS ss FROM spots JOIN middles USING (k, g) GROUP BY 1, 2),
        davies AS MATERIALIZED (SELECT k, avg(m) AS davies_bouldin FROM (SELECT p.k, max((p.dev + q.dev) / abs(p.c - q.c)) AS m
        FROM spreads p JOIN spreads q ON p.k = q.k AND p.g <> q.g GROUP BY p.k, p.g) GROUP BY 1),
        calinski AS MATERIALIZED (SELECT k, sum(ss) AS inertia, min(n) AS smallest, max(n) AS largest,
        sum(n * (c - t) * (c - t)) * (sum(n) - count(*)) / (sum(ss) * (count(*) - 1)) AS calinski_harabasz FROM spreads
        JOIN (SELECT k, sum(n * c) / sum(n) AS t FROM spreads GROUP BY 1) USING (k) GROUP BY 1),
        pairs AS MATERIALIZED (SELECT p.k AS k, p.g AS g, p.x AS x, any_value(p.w) AS w, q.g AS o, sum(q.w * abs(p.x - q.x)) AS d,
        sum(q.w) AS n FROM spots p JOIN spots q ON p.k = q.k GROUP BY 1, 2, 3, 5),
        ab AS MATERIALIZED (SELECT k, g, x, any_value(w) AS w, max(CASE WHEN o = g THEN d / nullif(n - 1, 0) END) AS a,
        min(CASE WHEN o <> g THEN d / n END) AS b FROM pairs GROUP BY 1, 2, 3),
        sil AS MATERIALIZED (SELECT k, sum(w * coalesce((b - a) / nullif(greatest(a, b), 0), 0)) / sum(w) AS silhouette
        FROM ab GROUP BY 1)
        SELECT CAST(k AS INTEGER) AS k, round_even(inertia, 2) AS inertia, round_even(silhouette, 4) AS silhouette,
        round_even(davies_bouldin, 4) AS davies_bouldin, round_even(calinski_harabasz, 2) AS calinski_harabasz,
        CAST(smallest AS BIGINT) AS smallest, CAST(largest AS BIGINT) AS largest
        FROM calinski JOIN davies USING (k) JOIN sil USING (k)"""
    out["peer_stats_published"] = f"SELECT {_titled('peer_stats')} FROM ({out['peer_stats_report']})"
    out["top_alerts_full"] = f"SELECT {_titled('top_alerts_full')} FROM ({out['top_alerts']})"
    out["event_robust_zscore"] = """WITH m AS MATERIALIZED (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events
        GROUP BY 1), d AS MATERIALIZED (SELECT event_type, any_value(med) AS med, quantile_cont(abs(value - med), 0.5) AS mad
        FROM events JOIN m USING (event_type) GROUP BY 1)
        SELECT event_id, event_type, round_even(0.6745 * (value - med) / greatest(mad, 0.001), 6) AS robust_z,
        abs(0.6745 * (value - med) / greatest(mad, 0.001)) > 3.5 AS flag_robust FROM events JOIN d USING (event_type)"""
    out["event_limits"] = """SELECT event_type, unnest([0.95::DOUBLE, 0.975::DOUBLE, 0.99::DOUBLE]) AS percentile,
        unnest([round_even(quantile_cont(value, 0.95), 6), round_even(quantile_cont(value, 0.975), 6),
        round_even(quantile_cont(value, 0.99), 6)]) AS limit_value FROM events GROUP BY event_type"""
    # The p-value integrates the density of Student's t beyond |t|, by Simpson's rule over x = |t| + s / (1 - s).
    out["spearman_report"] = _sql(
        """, ranks AS MATERIALIZED (SELECT rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS ra,
        rank() OVER (ORDER BY robust_z) + (count(*) OVER (PARTITION BY robust_z) - 1) / 2.0::DOUBLE AS rb FROM compared),
        rho AS MATERIALIZED (SELECT corr(ra, rb) AS r, count(*) - 2 AS v FROM ranks),
        tail AS MATERIALIZED (SELECT sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(
        lgamma((v + 1) / 2) - lgamma(v / 2) - ln(v * pi()) / 2 - (v + 1) / 2 * ln(1 + x * x / v)) / pow(1 - h, 2)) / 60000 * 2 AS p
        FROM (SELECT i, v, h, abs(r) * sqrt(v / (1 - r * r)) + h / (1 - h) AS x FROM rho, (SELECT i, i / 20000.1::DOUBLE AS h
        FROM range(20001) t(i))))
        SELECT 'Correlação de Spearman' AS metric, round_even(r, 4) AS value FROM rho
        UNION ALL SELECT 'P-valor', round_even(p, 6) FROM tail""",
        "compared",
    )
    for name, headings in (("alerts_by_cluster", ("peer_group", "alerts_n", "rows_n", "alerts_pct", "alert_rate_pct")),
                           ("alerts_by_cluster_report", ('"Cluster"', '"Alertas"', '"Registros do Cluster"',
                                                         '"% dos Alertas"', '"Taxa de Alertas no Cluster (%)"'))):
        g, a, n, p, r = headings
        out[name] = _sql(
            f"""SELECT peer_group AS {g}, x AS {a}, y AS {n}, {_pct('x', 'sum(x) OVER ()')} AS {p}, {_pct('x', 'y')} AS {r}
            FROM (SELECT peer_group, count(*) FILTER (WHERE status <> 'NORMAL') AS x, count(*) AS y FROM classified GROUP BY 1)
            WHERE x > 0""",
            "classified",
        )
    for name, score, flag in (("top_abs_z", "z", "flag_robust"), ("top_abs_robust", "robust_z", "flag_classic")):
        out[name] = _sql(
            f"""SELECT CAST(row_number() OVER (ORDER BY abs({score}) DESC, entity_id, month) AS INTEGER) AS position, entity_id,
            month, strftime(month, '%m/%Y') AS month_label, peer_group, total, round_even(z, 2) AS z,
            round_even(robust_z, 2) AS robust_z, {flag} AS other_flag FROM judged QUALIFY position <= 20""",
            "judged",
        )
    return out
