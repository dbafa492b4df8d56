"""For each query the DuckDB SQL that must return the same rows. Written from the rules, not from the Spark plans."""

from __future__ import annotations

from tallyforge.plans.match_queries import NAMES
from tallyforge.sources import texts

T = "chrono, invoice_id, line_number, supplier_id, quantity, total, discount, tax"

LINES = """
    pl AS (
        SELECT l_partkey AS ingredient_id, p_name AS name, l_orderkey AS invoice_id, l_linenumber AS line_number, l_suppkey AS supplier_id,
               s_name AS supplier_name, o_orderdate AS chrono, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
               l_extendedprice AS total, l_discount AS discount, l_tax AS tax, l_extendedprice * (1 - l_discount) AS net_total
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
    ), last_day AS (SELECT max(o_orderdate) AS d FROM orders)"""

HISTORY = f"""{LINES},
    lagged AS (SELECT *, lag(unit_price) OVER (PARTITION BY ingredient_id ORDER BY {T}) AS previous_price FROM pl),
    ph AS (
        SELECT *, unit_price - previous_price AS delta,
               CASE WHEN abs(previous_price) > 1e-6 THEN (unit_price - previous_price) / previous_price * 100 END AS delta_pct
        FROM lagged
    )"""

CONTRACTS = f"""{LINES},
    ct AS (
        SELECT *, CASE supplier_id % 3 WHEN 0 THEN 'weight' WHEN 1 THEN 'volume' ELSE 'countable' END AS family,
               CASE WHEN name LIKE 'cold%' THEN 'preserved' WHEN name LIKE 'new%' THEN 'fresh' ELSE 'unknown' END AS preservation,
               CASE supplier_id % 3 WHEN 0 THEN 'weight' WHEN 1 THEN 'volume' ELSE 'countable' END || ':' || CASE WHEN quantity >= 10 THEN '10+' ELSE '1+' END AS contract
        FROM pl
    )"""

KITCHEN = """
    ing AS (
        SELECT p_partkey AS ingredient_id, p_name AS name, p_retailprice AS current_price, p_size::DOUBLE AS purchase_quantity,
               row_number() OVER (ORDER BY p_partkey) - 1 AS ix,
               CASE WHEN p_retailprice > 0 AND p_size > 0 THEN p_retailprice / greatest(p_size::DOUBLE, 1.0) END AS unit_cost
        FROM part WHERE p_type IN ('MEDIUM', 'STANDARD', 'LARGE')
    ), rec AS (
        SELECT p_partkey AS recipe_id, CASE WHEN p_type = 'SMALL' THEN 'prep' ELSE 'dish' END AS type, p_size::DOUBLE AS output_quantity,
               CASE WHEN p_type <> 'SMALL' THEN p_retailprice * 3 END AS selling_price
        FROM part WHERE p_type IN ('PROMO', 'ECONOMY', 'SMALL')
    ), rx AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY recipe_id) - 1 AS ix FROM rec),
    sizes AS (SELECT (SELECT count(*) FROM ing) AS n, (SELECT count(*) FROM rec WHERE type = 'prep') AS m),
    edges AS (
        SELECT rx.recipe_id, ing.ingredient_id, NULL::BIGINT AS sub_recipe_id, (1 + (rx.ix + j) % 5)::DOUBLE AS quantity
        FROM rx, sizes, (VALUES (1), (2), (3)) AS v(j) JOIN ing ON TRUE WHERE ing.ix = (rx.ix * 7 + j * 13) % n
        UNION ALL
        SELECT d.recipe_id, NULL, p.recipe_id, (1 + d.ix % 3)::DOUBLE FROM rx d, sizes, rx p WHERE d.type = 'dish' AND p.type = 'prep' AND p.ix = (d.ix * 5) % m
        UNION ALL
        SELECT a.recipe_id, NULL, b.recipe_id, 1.0 FROM rx a JOIN rx b ON b.ix = a.ix + 1 WHERE a.type = 'prep' AND b.type = 'prep' AND a.ix % 4 <> 3
    ), walk AS (
        SELECT recipe_id AS root, recipe_id, 0 AS depth, 1.0::DOUBLE AS batches FROM rec
        UNION ALL
        SELECT w.root, e.sub_recipe_id, w.depth + 1, w.batches * e.quantity / s.output_quantity
        FROM walk w JOIN edges e ON e.recipe_id = w.recipe_id AND e.sub_recipe_id IS NOT NULL JOIN rec s ON s.recipe_id = e.sub_recipe_id WHERE w.depth < 10
    ), clo AS (SELECT root, recipe_id, min(depth) AS depth, sum(batches) AS batches FROM walk GROUP BY 1, 2),
    direct AS (SELECT e.recipe_id, e.ingredient_id, e.quantity, i.unit_cost, e.quantity * i.unit_cost AS line_cost FROM edges e LEFT JOIN ing i ON e.ingredient_id = i.ingredient_id WHERE e.ingredient_id IS NOT NULL),
    own AS (SELECT recipe_id, sum(line_cost) AS cost, count(*) AS n, count(*) FILTER (line_cost IS NULL) AS o FROM direct GROUP BY 1),
    cost AS (
        SELECT root AS recipe_id, sum(batches * own.cost) AS total_cost, sum(n)::BIGINT AS n_lines, sum(o)::BIGINT AS n_unresolved
        FROM clo JOIN own ON own.recipe_id = clo.recipe_id GROUP BY 1
    ), mar AS (
        SELECT r.recipe_id, selling_price, total_cost, (selling_price - total_cost) / selling_price * 100 AS margin_pct, total_cost / selling_price * 100 AS food_cost_pct
        FROM rec r LEFT JOIN cost c ON r.recipe_id = c.recipe_id WHERE r.type = 'dish'
    ), every AS (
        SELECT recipe_id, 'ingredient' AS kind, ingredient_id AS component_id, line_cost FROM direct
        UNION ALL
        SELECT e.recipe_id, 'prep', e.sub_recipe_id, e.quantity / s.output_quantity * c.total_cost
        FROM edges e JOIN rec s ON s.recipe_id = e.sub_recipe_id JOIN cost c ON c.recipe_id = e.sub_recipe_id
    ), ordered AS (
        SELECT *, sum(line_cost) OVER (PARTITION BY recipe_id) AS whole,
               row_number() OVER (PARTITION BY recipe_id ORDER BY round(line_cost, 6) DESC, kind, component_id) AS k
        FROM every
    ), tops AS (SELECT recipe_id, kind, component_id, line_cost, line_cost / whole * 100 AS share_pct FROM ordered WHERE k = 1 AND whole > 0),
    used AS (SELECT ingredient_id, round(sum(line_cost::DECIMAL(28, 8)), 4)::DOUBLE AS line_cost, count(DISTINCT recipe_id) AS n_recipes FROM direct GROUP BY 1),
    expo AS (
        SELECT ingredient_id, line_cost, n_recipes, line_cost / (SELECT round(sum(line_cost::DECIMAL(28, 8)), 4)::DOUBLE FROM used) * 100 AS share_pct,
               floor(round(line_cost * (n_recipes * 30), 6) + 0.5)::BIGINT AS monthly FROM used
    )"""

EVENTS = """
    ev AS (
        SELECT user_id AS ingredient_id, event_type AS supplier_name, ts AS chrono, event_id, value AS unit_price,
               lag(value) OVER w AS previous_price, lag(event_type) OVER w AS from_supplier
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), eh AS (
        SELECT *, unit_price - previous_price AS delta, CASE WHEN abs(previous_price) > 1e-6 THEN (unit_price - previous_price) / previous_price * 100 END AS delta_pct FROM ev
    )"""


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


FOLD = "translate(lower({0}), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy')"


def simple(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({FOLD.format(x)}, '\([^)]*\)', ' ', 'g'), '[-_/]+', ' ', 'g'), '\s+', ' ', 'g'))"


def since(days: int) -> str:
    return f"chrono >= (SELECT d FROM last_day) - INTERVAL {days} DAY"


def _by_form(name: str, at: int, kind: str, text: bool = False) -> str:
    """A CASE over the forms of phrases for one of their columns; texts that are no expression are quoted."""
    cases = "".join(f" WHEN {k} THEN {_quoted(f[at]) if text and not f[at].startswith('CASE') else f[at]}" for k, f in enumerate(texts.PHRASE_FORMS) if f[at] is not None)
    return f"(CASE k{cases} END)::{kind} AS {name}"


PHRASES = f"""
    pt AS (SELECT p_partkey AS id, p_partkey % {len(texts.PHRASE_FORMS)} AS k, (p_size + 1)::DOUBLE AS t, p_retailprice AS price FROM part),
    pf AS (
        SELECT id, price, {_by_form('told', 3, 'VARCHAR', True)}, {_by_form('bought', 4, 'DOUBLE')}, {_by_form('"inner"', 5, 'DOUBLE')}, {_by_form('size', 6, 'DOUBLE')}, {_by_form('unit', 7, 'VARCHAR', True)},
               {_by_form('containers', 8, 'DOUBLE')}, {_by_form('row_usable', 9, 'DOUBLE')}, {_by_form('source', 10, 'VARCHAR', True)}, {_by_form('weak', 11, 'BOOLEAN')} FROM pt
    ),
    ph AS (
        SELECT *, split_part(told, ':', 1) AS tier, nullif(split_part(told, ':', 2), '') AS reason, CASE WHEN unit IN ('kg', 'g') THEN 'g' WHEN unit = 'un' THEN 'un' WHEN unit IS NOT NULL THEN 'ml' END AS usable_unit,
               bought * coalesce("inner", 1) * size * CASE unit WHEN 'kg' THEN 1000 WHEN 'L' THEN 1000 WHEN 'cl' THEN 10 ELSE 1 END AS usable FROM pf
    )"""

ORACLE_SQL: dict[str, str] = {
    "price_chain_latest_moves": f"""
        WITH {HISTORY}, n AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY chrono DESC, invoice_id DESC, line_number DESC, supplier_id DESC, quantity DESC, total DESC, discount DESC, tax DESC) AS k FROM ph)
        SELECT ingredient_id, name, supplier_name, chrono, unit_price, previous_price, delta, delta_pct FROM n WHERE k = 1""",
    "price_history_guarded": f"""
        WITH {CONTRACTS}, l AS (
            SELECT *, lag(unit_price) OVER w AS pp, lag(family) OVER w AS pf, lag(preservation) OVER w AS pv, lag(contract) OVER w AS pc FROM ct WINDOW w AS (PARTITION BY ingredient_id ORDER BY {T})
        ), r AS (
            SELECT *, CASE WHEN pp IS NULL THEN NULL WHEN pf <> family THEN 'unit_family_mismatch'
                WHEN pv <> 'unknown' AND preservation <> 'unknown' AND pv <> preservation THEN 'preservation_mismatch'
                WHEN greatest(pp, unit_price) / least(pp, unit_price) > 14 THEN 'extreme_price_ratio'
                WHEN pc <> contract AND greatest(pp, unit_price) / least(pp, unit_price) > 2 THEN 'format_change' END AS reason FROM l
        )
        SELECT ingredient_id, invoice_id, line_number, supplier_id, unit_price, CASE WHEN reason IS NULL THEN pp END AS previous_price, reason FROM r""",
    "previous_unit_price": f"""
        WITH {HISTORY}, n AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY chrono DESC, invoice_id DESC, line_number DESC, supplier_id DESC, quantity DESC, total DESC, discount DESC, tax DESC) AS k FROM ph)
        SELECT ingredient_id, coalesce(max(previous_price) FILTER (k = 1), max(unit_price) FILTER (k = 2)) AS previous_unit_price FROM n GROUP BY 1""",
    "price_window_stats_90_180": f"""
        WITH {LINES}
        SELECT ingredient_id, count(*) FILTER ({since(90)}) AS n_90, count(*) AS n_180, min(unit_price) FILTER ({since(90)}) AS min_90, max(unit_price) FILTER ({since(90)}) AS max_90,
               round(sum(unit_price::DECIMAL(28, 8)) FILTER ({since(90)}), 4)::DOUBLE / nullif(count(*) FILTER ({since(90)}), 0) AS avg_90, min(unit_price) AS min_180, max(unit_price) AS max_180, round(sum(unit_price::DECIMAL(28, 8)), 4)::DOUBLE / count(*) AS avg_180
        FROM pl WHERE unit_price > 0 AND {since(180)} GROUP BY 1""",
    "volatile_by_frequency": f"""
        WITH {LINES} SELECT ingredient_id, count(*) AS n_changes FROM pl WHERE {since(90)} GROUP BY 1 HAVING count(*) >= 4 ORDER BY n_changes DESC, ingredient_id LIMIT 25""",
    "volatile_by_range": f"""
        WITH {LINES} SELECT ingredient_id, count(*) AS n_prices, min(unit_price) AS least, max(unit_price) AS most, (max(unit_price) - min(unit_price)) / min(unit_price) AS spread
        FROM pl WHERE unit_price > 0 AND {since(180)} GROUP BY 1 HAVING count(*) >= 3 AND (max(unit_price) - min(unit_price)) / min(unit_price) >= 0.15""",
    "largest_increases": f"""
        WITH {HISTORY}, t AS (SELECT * FROM ph WHERE delta > 1e-6 AND {since(90)} ORDER BY delta DESC, ingredient_id, {T} LIMIT 25)
        SELECT ingredient_id, invoice_id, supplier_name, unit_price, previous_price, delta FROM t""",
    "recent_price_moves": f"""
        WITH {HISTORY}, n AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY abs(delta_pct) DESC, {T}) AS k FROM ph WHERE abs(delta_pct) >= 0.5 AND {since(7)}),
        t AS (SELECT * FROM n WHERE k = 1 ORDER BY abs(delta_pct) DESC, ingredient_id LIMIT 8)
        SELECT ingredient_id, supplier_name, unit_price, delta_pct FROM t""",
    "price_variability": f"""
        WITH {LINES} SELECT ingredient_id, count(*) AS n_prices, round(avg(unit_price), 4) AS mean, round(stddev_pop(unit_price), 4) AS spread, round(stddev_pop(unit_price) / avg(unit_price), 4) AS cv,
               stddev_pop(unit_price) / avg(unit_price) < 0.06 AS stable FROM pl GROUP BY 1 HAVING count(*) >= 2""",
    "invoice_month_kpis": f"""
        WITH {LINES}, s AS (SELECT date_trunc('month', chrono)::DATE AS month, supplier_name, sum(total) AS spend FROM pl GROUP BY 1, 2),
        b AS (SELECT month, sum(spend) AS spend FROM s GROUP BY 1),
        t AS (SELECT month, supplier_name, row_number() OVER (PARTITION BY month ORDER BY round(spend, 4) DESC, supplier_name DESC) AS k FROM s),
        c AS (SELECT date_trunc('month', chrono)::DATE AS month, count(DISTINCT invoice_id) AS n_invoices, count(*) AS n_lines FROM pl GROUP BY 1)
        SELECT b.month, n_invoices, n_lines, t.supplier_name AS top_supplier, round(b.spend, 4) AS spend, round(p.spend, 4) AS previous_spend, round((b.spend / p.spend - 1) * 100, 4) AS mom_pct
        FROM b JOIN c ON b.month = c.month JOIN t ON b.month = t.month AND k = 1 LEFT JOIN b p ON p.month + INTERVAL 1 MONTH = b.month""",
    "top_supplier_by_month": f"""
        WITH {LINES}, s AS (SELECT date_trunc('month', chrono)::DATE AS month, supplier_name, round(sum(total), 4) AS spend FROM pl GROUP BY 1, 2),
        t AS (SELECT *, (row_number() OVER (PARTITION BY month ORDER BY spend DESC, supplier_name))::INTEGER AS rank FROM s)
        SELECT month, rank, supplier_name, spend FROM t WHERE rank <= 3""",
    "pricing_freshness": f"""
        WITH {LINES}, {KITCHEN.strip()}, l AS (SELECT ingredient_id, max(chrono) AS last_purchase FROM pl GROUP BY 1),
        d AS (SELECT i.ingredient_id, last_purchase, greatest(floor(epoch((SELECT d FROM last_day) - last_purchase) / 86400), 0)::INTEGER AS days FROM ing i LEFT JOIN l ON i.ingredient_id = l.ingredient_id)
        SELECT ingredient_id, last_purchase, CASE WHEN last_purchase IS NOT NULL THEN days END AS days,
               CASE WHEN last_purchase IS NULL THEN 'unknown' WHEN days < 30 THEN 'fresh' WHEN days < 90 THEN 'aging' WHEN days < 180 THEN 'stale' ELSE 'critical' END AS level FROM d""",
    "unit_conversion_matrix": f"""
        WITH m AS (SELECT p_partkey AS id, p_size / 8 AS quantity, {texts.UNIT_SQL} AS unit FROM part), u AS (SELECT id, quantity::DOUBLE AS quantity, lower(trim(unit)) AS unit FROM m),
        f AS (SELECT *, CASE unit WHEN 'kg' THEN 1000 WHEN 'l' THEN 1000 WHEN 'cl' THEN 10 ELSE 1 END AS factor, CASE WHEN unit IN ('kg', 'g') THEN 'g' WHEN unit IN ('l', 'cl', 'ml') THEN 'ml' WHEN unit = 'un' THEN 'un' END AS base_unit FROM u)
        SELECT id, quantity * factor AS base_quantity, base_unit, CASE base_unit WHEN 'g' THEN 'weight' WHEN 'ml' THEN 'volume' WHEN 'un' THEN 'countable' END AS family,
               (CASE WHEN quantity >= 0.5 AND quantity < 1 AND base_unit IN ('g', 'ml') THEN quantity * 1000 ELSE quantity END)::DOUBLE AS repaired FROM f""",
    "line_cost": f"WITH RECURSIVE {KITCHEN} SELECT recipe_id, ingredient_id, quantity, unit_cost, line_cost FROM direct",
    "recipe_closure": f"WITH RECURSIVE {KITCHEN} SELECT root, recipe_id, depth::INTEGER AS depth, round(batches, 4) AS batches FROM clo WHERE depth > 0",
    "recipe_cost_rollup": f"WITH RECURSIVE {KITCHEN} SELECT recipe_id, round(total_cost, 4) AS total_cost, n_lines, n_unresolved FROM cost",
    "recipe_margin_health": f"""
        WITH RECURSIVE {KITCHEN} SELECT recipe_id, selling_price, round(total_cost, 4) AS total_cost, round(margin_pct, 4) AS margin_pct, round(food_cost_pct, 4) AS food_cost_pct,
               CASE WHEN margin_pct IS NULL THEN 'unknown' WHEN margin_pct >= 65 THEN 'healthy' WHEN margin_pct >= 55 THEN 'watch' ELSE 'critical' END AS health FROM mar""",
    "recipe_top_line": f"WITH RECURSIVE {KITCHEN} SELECT recipe_id, kind, component_id, round(line_cost, 4) AS line_cost, round(share_pct, 4) AS share_pct FROM tops",
    "margin_impact_whatif": f"""
        WITH RECURSIVE {KITCHEN}, nown AS (SELECT recipe_id, sum(line_cost * CASE WHEN ingredient_id % 10 = 0 THEN 1.1 ELSE 1 END) AS cost FROM direct GROUP BY 1),
        ncost AS (SELECT root AS recipe_id, sum(batches * nown.cost) AS new_cost FROM clo JOIN nown ON nown.recipe_id = clo.recipe_id GROUP BY 1),
        w AS (SELECT r.recipe_id, total_cost AS old_cost, new_cost, (selling_price - total_cost) / selling_price * 100 - (selling_price - new_cost) / selling_price * 100 AS margin_drop
              FROM rec r JOIN cost c ON r.recipe_id = c.recipe_id JOIN ncost n ON n.recipe_id = r.recipe_id WHERE r.type = 'dish' AND abs(new_cost - total_cost) > 1e-9)
        SELECT recipe_id, round(old_cost, 4) AS old_cost, round(new_cost, 4) AS new_cost, round(margin_drop, 4) AS margin_drop, CASE WHEN margin_drop > 5 THEN 'HIGH' WHEN margin_drop > 2 THEN 'MEDIUM' ELSE 'LOW' END AS impact FROM w""",
    "affected_recipes": f"""
        WITH RECURSIVE {HISTORY}, {KITCHEN.strip()}, ch AS (SELECT DISTINCT ingredient_id FROM ph WHERE abs(delta_pct) >= 5 AND {since(30)}),
        hit AS (SELECT root AS recipe_id, count(DISTINCT d.ingredient_id) AS n_ingredients FROM clo JOIN direct d ON d.recipe_id = clo.recipe_id JOIN ch ON ch.ingredient_id = d.ingredient_id GROUP BY 1)
        SELECT hit.recipe_id, type, n_ingredients FROM hit JOIN rec ON rec.recipe_id = hit.recipe_id""",
    "usage_counts": f"""
        WITH RECURSIVE {KITCHEN} SELECT 'ingredient' AS kind, ingredient_id AS component_id, count(DISTINCT recipe_id) AS n_recipes FROM edges WHERE ingredient_id IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'prep', sub_recipe_id, count(DISTINCT recipe_id) FROM edges WHERE sub_recipe_id IS NOT NULL GROUP BY 2""",
    "alert_spike": f"""
        WITH {EVENTS}, cut AS (SELECT max(ts) - INTERVAL 14 DAY AS c FROM events), up AS (SELECT *, chrono >= (SELECT c FROM cut) AS recent FROM eh WHERE delta_pct > 0 AND delta > 1e-6),
        top AS (SELECT ingredient_id, delta_pct AS pct, delta FROM (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY delta_pct DESC, delta DESC) AS k FROM up WHERE recent) WHERE k = 1),
        old AS (SELECT ingredient_id, delta_pct, row_number() OVER (PARTITION BY ingredient_id ORDER BY delta_pct) - 1 AS k, count(*) OVER (PARTITION BY ingredient_id) AS n FROM up WHERE NOT recent),
        base AS (SELECT ingredient_id, n AS samples, delta_pct AS baseline FROM old WHERE k = n // 2),
        s AS (SELECT t.ingredient_id, pct, delta, coalesce(baseline, 0.0) AS baseline, coalesce(samples, 0) AS samples FROM top t LEFT JOIN base b ON t.ingredient_id = b.ingredient_id),
        f AS (SELECT * FROM s WHERE pct >= 18 OR delta >= 0.08 OR (samples >= 2 AND pct - baseline >= 10) OR (pct >= 12 AND (samples = 0 OR pct - baseline >= 5)) ORDER BY round(pct, 6) DESC, ingredient_id LIMIT 25)
        SELECT ingredient_id, pct, delta, baseline, samples, CASE WHEN pct >= 28 OR delta >= 0.2 THEN 'high' WHEN pct >= 18 THEN 'medium' ELSE 'low' END AS severity FROM f""",
    "alert_supplier_trend": f"""
        WITH {HISTORY}, w AS (SELECT *, row_number() OVER (PARTITION BY supplier_name ORDER BY chrono, ingredient_id, invoice_id, line_number, supplier_id, quantity, total, discount, tax) AS k, count(*) OVER (PARTITION BY supplier_name) AS n FROM ph WHERE {since(180)}),
        a AS (SELECT supplier_name, count(*) AS n_rows, avg(unit_price) FILTER (k <= n // 2) AS early_avg, avg(unit_price) FILTER (k > n // 2) AS late_avg, count(*) FILTER (delta > 1e-6) AS n_rises, count(DISTINCT ingredient_id) AS n_ingredients FROM w WHERE n >= 4 GROUP BY 1),
        d AS (SELECT *, CASE WHEN early_avg > 1e-6 THEN (late_avg - early_avg) / early_avg ELSE 0 END AS drift, n_rises / n_rows AS rise_ratio FROM a),
        f AS (SELECT * FROM d WHERE drift > 0.025 OR rise_ratio >= 0.5 ORDER BY n_rows DESC, supplier_name LIMIT 4)
        SELECT supplier_name, n_rows, n_rises, n_ingredients, round(early_avg, 4) AS early_avg, round(late_avg, 4) AS late_avg, round(drift, 4) AS drift, round(rise_ratio, 4) AS rise_ratio,
               CASE WHEN drift * 100 > 8 OR rise_ratio >= 0.65 THEN 'high' WHEN drift * 100 > 4 THEN 'medium' ELSE 'low' END AS severity FROM f""",
    "alert_monthly_loss": f"""
        WITH RECURSIVE {HISTORY}, {KITCHEN.strip()}, n AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY chrono DESC, invoice_id DESC, line_number DESC, supplier_id DESC, quantity DESC, total DESC, discount DESC, tax DESC) AS k FROM ph),
        m AS (SELECT ingredient_id, delta_pct FROM n WHERE k = 1 AND delta_pct > 0 AND {since(30)}),
        s AS (SELECT coalesce(sum(line_cost * delta_pct / 100), 0) AS total, count(DISTINCT recipe_id) AS n_recipes FROM direct d JOIN m ON m.ingredient_id = d.ingredient_id)
        SELECT round(total, 4) AS total, n_recipes, CASE WHEN total >= 5 THEN 'high' WHEN total >= 2 THEN 'medium' ELSE 'low' END AS severity FROM s WHERE total >= 0.08""",
    "portfolio_exposure": f"WITH RECURSIVE {KITCHEN} SELECT ingredient_id, n_recipes, monthly, line_cost, share_pct FROM expo",
    "category_slices": f"""
        WITH RECURSIVE {KITCHEN} SELECT split_part(name, ' ', -1) AS category, count(*) AS n_ingredients, sum(monthly)::BIGINT AS monthly, round(sum(line_cost), 4) AS line_cost, round(sum(share_pct), 4) AS share_pct
        FROM expo JOIN ing ON ing.ingredient_id = expo.ingredient_id GROUP BY 1""",
    "category_pressure": f"""
        WITH RECURSIVE {HISTORY}, {KITCHEN.strip()}, mv AS (SELECT ingredient_id, avg(delta_pct) AS trend, max(delta_pct) AS most FROM ph WHERE {since(90)} GROUP BY 1),
        g AS (SELECT split_part(name, ' ', -1) AS category, sum(monthly)::BIGINT AS monthly, avg(trend) AS avg_trend, max(most) AS max_inflation
              FROM expo JOIN ing ON ing.ingredient_id = expo.ingredient_id LEFT JOIN mv ON mv.ingredient_id = expo.ingredient_id GROUP BY 1)
        SELECT category, monthly, round(avg_trend, 4) AS avg_trend, max_inflation, CASE WHEN avg_trend >= 5 THEN 'rising' WHEN avg_trend <= -5 THEN 'easing' ELSE 'stable' END AS label FROM g""",
    "top_exposures": f"""
        WITH RECURSIVE {HISTORY}, {KITCHEN.strip()}, mv AS (SELECT ingredient_id, avg(delta_pct) AS trend FROM ph WHERE {since(90)} GROUP BY 1),
        s AS (SELECT e.ingredient_id, monthly, coalesce(trend, 0) AS trend, share_pct, round(0.35 * monthly + 12 * abs(coalesce(trend, 0)) + 8 * least(n_recipes, 8) + 2 * share_pct, 4) AS score FROM expo e LEFT JOIN mv ON mv.ingredient_id = e.ingredient_id)
        SELECT ingredient_id, score, monthly, round(trend, 4) AS trend, round(share_pct, 4) AS share_pct FROM s ORDER BY score DESC, ingredient_id LIMIT 15""",
    "supplier_windows": f"""
        WITH {HISTORY}, w AS (SELECT * FROM ph WHERE {since(90)}),
        u AS (SELECT supplier_name, ingredient_id, row_number() OVER (PARTITION BY supplier_name ORDER BY round(delta_pct, 6) DESC, ingredient_id) AS k FROM w WHERE delta_pct > 0),
        d AS (SELECT supplier_name, ingredient_id, row_number() OVER (PARTITION BY supplier_name ORDER BY round(delta_pct, 6), ingredient_id) AS k FROM w WHERE delta_pct < 0)
        SELECT w.supplier_name, count(delta_pct) AS n_events, count(DISTINCT invoice_id) AS n_invoices, round(avg(delta_pct), 4) AS avg_pct, round(sum(total), 4) AS spend, any_value(u.ingredient_id) AS top_up, any_value(d.ingredient_id) AS top_down
        FROM w LEFT JOIN u ON u.supplier_name = w.supplier_name AND u.k = 1 LEFT JOIN d ON d.supplier_name = w.supplier_name AND d.k = 1 GROUP BY 1""",
    "supplier_watchlist": f"""
        WITH {HISTORY}, g AS (SELECT supplier_name, count(*) FILTER (delta_pct > 0) AS n_up, count(*) FILTER (delta_pct < 0) AS n_down, max(abs(delta_pct)) AS max_pct FROM ph WHERE abs(delta_pct) >= 0.5 AND {since(90)} GROUP BY 1)
        SELECT supplier_name, n_up, n_down, max_pct, CASE WHEN n_up > n_down THEN 'rising' WHEN n_up < n_down THEN 'easing' ELSE 'mixed' END AS status,
               CASE WHEN max_pct >= 15 AND n_up > 0 THEN 'high' WHEN max_pct >= 5 THEN 'medium' ELSE 'low' END AS risk FROM g""",
    "supplier_switches": f"""
        WITH {EVENTS} SELECT ingredient_id, event_id, from_supplier, supplier_name, previous_price AS from_price, unit_price, delta_pct AS change_pct,
               CASE WHEN delta_pct > 2 THEN 'dearer' WHEN delta_pct < -2 THEN 'cheaper' WHEN delta_pct IS NOT NULL THEN 'stable' END AS kind FROM eh WHERE from_supplier <> supplier_name""",
    "supplier_temporal_trend": f"""
        WITH {HISTORY}, g AS (SELECT supplier_name, avg(delta_pct) FILTER ({since(30)}) AS late_pct, avg(delta_pct) FILTER (NOT {since(30)}) AS early_pct FROM ph WHERE {since(90)} GROUP BY 1)
        SELECT supplier_name, round(late_pct, 4) AS late_pct, round(early_pct, 4) AS early_pct,
               CASE WHEN late_pct - early_pct IS NULL THEN 'unknown' WHEN late_pct - early_pct >= 3 THEN 'accelerating' WHEN late_pct - early_pct <= -3 THEN 'easing' ELSE 'steady' END AS trend FROM g""",
    "line_validation_findings": f"""
        WITH {LINES}, v AS (SELECT supplier_name, abs(quantity * unit_price - net_total) AS variance, abs(quantity * unit_price - net_total) / abs(quantity * unit_price) * 100 AS pct FROM pl),
        f AS (SELECT supplier_name, 'mathematics' AS finding, variance FROM v WHERE variance > 0.5 OR pct > 5 UNION ALL SELECT supplier_name, 'extraction_mathematics', variance FROM v WHERE variance > 0.5 AND pct > 5)
        SELECT supplier_name, finding, count(*) AS n_lines, round(sum(variance), 2) AS variance FROM f GROUP BY 1, 2""",
    "missing_amount_fill": f"""
        WITH {LINES} SELECT ingredient_id, invoice_id, line_number, supplier_id, quantity, CASE WHEN line_number % 3 = 0 THEN total / quantity ELSE unit_price END AS unit_price,
               CASE WHEN line_number % 3 = 1 THEN quantity * unit_price ELSE total END AS total, line_number % 3 IN (0, 1) AS was_filled FROM pl""",
    "duplicate_names": f"WITH RECURSIVE {KITCHEN} SELECT name AS key, count(*) AS n_entries, min(ingredient_id) AS least_id FROM ing GROUP BY 1 HAVING count(*) >= 2",
    "reference_counts": f"""
        WITH RECURSIVE {KITCHEN}, {NAMES.strip()} SELECT i.ingredient_id, (SELECT count(*) FROM edges e WHERE e.ingredient_id = i.ingredient_id) AS n_recipes,
               (SELECT count(*) FROM lineitem WHERE l_partkey = i.ingredient_id) AS n_purchases, (SELECT count(*) FROM al WHERE al.ingredient_id = i.ingredient_id) AS n_aliases FROM ing i""",
    "orphans": f"WITH RECURSIVE {KITCHEN} SELECT ingredient_id FROM ing i WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.ingredient_id = i.ingredient_id)",
    "merge_survivor": f"""
        WITH RECURSIVE {KITCHEN}, c AS (SELECT ingredient_id, name AS key, (SELECT count(*) FROM edges e WHERE e.ingredient_id = i.ingredient_id) + (SELECT count(*) FROM lineitem WHERE l_partkey = i.ingredient_id) AS refs FROM ing i),
        s AS (SELECT key, ingredient_id AS survivor FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY refs DESC, ingredient_id) AS k FROM c) WHERE k = 1)
        SELECT c.key, survivor, ingredient_id AS merged_id, refs AS "references" FROM c JOIN s ON c.key = s.key WHERE ingredient_id <> survivor""",
    "alert_below_target": f"""
        WITH RECURSIVE {KITCHEN} SELECT 'below_target' AS kind, recipe_id AS subject_id, CASE WHEN margin_pct < 55 THEN 'high' ELSE 'medium' END AS severity, round(65 - margin_pct, 4) AS priority FROM mar WHERE margin_pct < 65""",
    "alert_concentration": f"""
        WITH RECURSIVE {KITCHEN} SELECT 'concentration' AS kind, recipe_id AS subject_id, CASE WHEN share_pct >= 80 THEN 'medium' ELSE 'low' END AS severity, round(share_pct, 4) AS priority FROM tops WHERE share_pct >= 55""",
    "alert_stale": f"""
        WITH {LINES}, d AS (SELECT ingredient_id, floor(epoch((SELECT d FROM last_day) - max(chrono)) / 86400)::INTEGER AS days FROM pl JOIN part ON p_partkey = ingredient_id WHERE p_type IN ('MEDIUM', 'STANDARD', 'LARGE') GROUP BY 1)
        SELECT 'stale' AS kind, ingredient_id AS subject_id, CASE WHEN days >= 180 THEN 'medium' ELSE 'low' END AS severity, days::DOUBLE AS priority FROM d WHERE days >= 45 ORDER BY days DESC, ingredient_id LIMIT 4""",
    "dual_read_metrics": """
        WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER AS qty FROM lineitem),
        m AS (SELECT CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 7 = 0 THEN l_partkey + 1 ELSE l_partkey END AS v, CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 11 <> 0 THEN l_partkey END AS p, l_linenumber % 2 = 0 AS stored FROM i),
        a AS (SELECT *, CASE WHEN NOT stored THEN 'missing' WHEN v IS NULL AND p IS NULL THEN 'aligned_unmatched' WHEN v = p THEN 'aligned' WHEN v IS NULL THEN 'stored_only' WHEN p IS NULL THEN 'computed_only' ELSE 'different' END AS alignment FROM m)
        SELECT alignment, count(*) AS n_items, count(CASE WHEN stored THEN p ELSE v END) AS n_effective FROM a GROUP BY 1""",
    "normalized_name_keys": rf"""
        WITH n AS (SELECT p_partkey AS id, {texts.NAME_SQL} AS name FROM part), s AS (SELECT id, {simple('name')} AS simple FROM n),
        a AS (SELECT id, simple, regexp_replace(simple, '[0-9]+([.,][0-9]+)?\s*[x*]\s*[0-9]+([.,][0-9]+)?', ' ', 'g') AS c FROM s),
        w AS (SELECT id, simple, list_filter(string_split_regex(regexp_replace(c, '([0-9]([.,][0-9]+)?) +(kg|g|gr|mg|l|lt|cl|dl|ml|un|uni|unid|pcs|cx|sc|emb|pack)( |$)', '\1 ', 'g'), '[^a-z0-9.,]+'),
                     lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+([.,][0-9]+)?(kg|g|gr|mg|l|lt|cl|dl|ml|un|uni|unid|pcs|cx|sc|emb|pack)?') AND NOT regexp_full_match(t, 'kg|g|gr|mg|l|lt|cl|dl|ml|un|uni|unid|pcs|cx|sc|emb|pack')) AS ws FROM a)
        SELECT id, simple, array_to_string(ws, ' ') AS canonical FROM w""",
    "dice_similarity": f"""
        WITH RECURSIVE {KITCHEN}, nm AS (SELECT DISTINCT name FROM ing),
        g AS (SELECT name, substr(name, i, 2) AS g, count(*) AS n FROM nm, unnest(range(1, length(name))) AS t(i) GROUP BY 1, 2),
        p AS (SELECT a.name, b.name AS other FROM nm a JOIN nm b ON a.name < b.name AND left(a.name, 1) = left(b.name, 1)),
        c AS (SELECT p.name, p.other, coalesce(sum(CASE WHEN y.n IS NOT NULL THEN least(x.n, y.n) END), 0) AS common FROM p LEFT JOIN g x ON x.name = p.name LEFT JOIN g y ON y.name = p.other AND y.g = x.g GROUP BY 1, 2)
        SELECT name, other, round(2.0 * common / (length(name) + length(other) - 2), 4)::DOUBLE AS dice, levenshtein(name, other)::INTEGER AS distance FROM c""",
    "operational_health": None,
    "price_bumps": f"WITH RECURSIVE {KITCHEN} SELECT recipe_id, round(greatest(0.5, total_cost / (1 - 0.65) - selling_price), 4) AS bump FROM mar WHERE margin_pct < 65",
    "sensitivity": f"WITH RECURSIVE {KITCHEN} SELECT ingredient_id, floor(monthly * 0.1 + 0.5)::BIGINT AS ten_percent FROM expo WHERE floor(monthly * 0.1 + 0.5) >= 1",
    "catalog_unit_costs": """
        SELECT p_partkey AS ingredient_id, p_retailprice / greatest(p_size::DOUBLE, 1.0) AS unit_cost, CASE WHEN p_size = 1000 THEN 'g' WHEN p_size > 1000 THEN 'ml' ELSE 'un' END AS base_unit
        FROM part WHERE p_type IN ('MEDIUM', 'STANDARD', 'LARGE')""",
    "invoice_dates": f"""
        WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN 'soon' END AS raw FROM orders) SELECT id, CASE WHEN length(raw) = 10 THEN coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%d/%m/%Y'), try_strptime(raw, '%d-%m-%Y')) END::DATE AS date FROM d""",
    "streaming_price_chain": f"""
        WITH {EVENTS} SELECT ingredient_id, event_id, unit_price, previous_price, delta, delta_pct FROM eh""",
    "purchase_structure_parse": f"""
        WITH {PHRASES}
        SELECT id, 0 AS line, tier, reason, bought, "inner", size, unit, usable, usable_unit, price / usable * CASE WHEN usable_unit IN ('g', 'ml') THEN 1000.0::DOUBLE ELSE 1 END AS cost FROM ph
        UNION ALL
        SELECT doc_id, place::INTEGER, 'none', 'no_measure', NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM documents)
        WHERE regexp_matches(l, '[0-9]') AND NOT regexp_matches(l, '(?i)[0-9]\\s*(kg|g|mg|ml|cl|l)')""",
    "usable_stock": f"""
        WITH {PHRASES}
        SELECT id, containers, row_usable AS usable, usable_unit, source, weak, price / row_usable * CASE WHEN usable_unit IN ('g', 'ml') THEN 1000.0::DOUBLE ELSE 1 END AS cost FROM ph WHERE row_usable IS NOT NULL""",
    "supplier_keys": f"""
        WITH s AS (SELECT s_suppkey AS id, {texts.SUPPLIER_SQL} AS name FROM supplier), f AS (SELECT id, {FOLD.format('name')} AS k FROM s),
        x AS (SELECT id, regexp_replace(regexp_replace(k, '\\.(pdf|png|jpe?g|xlsx?)$', ''), '[,\\s]+(lda|ltda|sa|s\\.a|unipessoal|inc|llc|ltd|gmbh)\\.?\\s*$', '') AS k FROM f)
        SELECT id, trim(regexp_replace(k, '[^a-z0-9]+', ' ', 'g')) AS key FROM x""",
}
_ORDERED = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, priority DESC, kind, subject_id"
ORACLE_SQL["alerts_ranked"] = f"""
    WITH e AS (SELECT * FROM ({ORACLE_SQL['alert_below_target']}) UNION ALL SELECT * FROM ({ORACLE_SQL['alert_concentration']}) UNION ALL SELECT * FROM ({ORACLE_SQL['alert_stale']})),
    t AS (SELECT *, row_number() OVER (ORDER BY {_ORDERED}) AS place FROM e)
    SELECT place::INTEGER AS place, kind, subject_id, severity, priority FROM t WHERE place <= 16"""
ORACLE_SQL["operational_health"] = f"""
    WITH RECURSIVE {KITCHEN}, k AS (SELECT (SELECT count(*) FROM ({ORACLE_SQL['alert_supplier_trend']})) AS trends, (SELECT count(*) FROM ({ORACLE_SQL['volatile_by_frequency']})) AS volatile)
    SELECT count(*) AS n_dishes, floor(count(*) FILTER (margin_pct >= 65) / count(*) * 100 + 0.5)::BIGINT AS on_target_pct, count(*) FILTER (margin_pct < 55) AS n_at_risk,
           round(avg(food_cost_pct), 4) AS avg_food_cost_pct, (SELECT greatest(0, 100 - 18 * trends - 12 * volatile) FROM k)::BIGINT AS stability FROM mar"""

ORACLE_SQL |= {
    "hidden_orphans": f"""
        WITH RECURSIVE {KITCHEN}, e AS (
            SELECT ingredient_id, CASE WHEN ingredient_id % 4 = 0 THEN name ELSE concat(name, ' ', {texts.BRAND_SQL.replace('AS STRING', 'AS VARCHAR').replace('p_partkey', 'ingredient_id')}) END AS name,
                   (SELECT count(*) FROM edges WHERE edges.ingredient_id = ing.ingredient_id) AS n FROM ing
        ) SELECT a.ingredient_id, a.name, min(b.ingredient_id) AS "by" FROM e a JOIN e b ON b.n > 0 AND len(list_filter(string_split(a.name, ' '), lambda w: NOT contains(b.name, w))) = 0 WHERE a.n = 0 GROUP BY 1, 2""",
    "purchase_timeline": f"""
        WITH {EVENTS}, m AS (
            SELECT *, min(unit_price) OVER p AS lo, max(unit_price) OVER p AS hi, avg(unit_price) OVER p AS mean, row_number() OVER (PARTITION BY ingredient_id, unit_price ORDER BY chrono, event_id) AS k,
                   row_number() OVER (PARTITION BY ingredient_id ORDER BY chrono DESC, event_id DESC) = 1 AND previous_price IS NOT NULL AS newest
            FROM ev WINDOW p AS (PARTITION BY ingredient_id)
        ), l AS (
            SELECT ingredient_id, event_id, hi > lo AND unit_price = lo AND k = 1 AS is_best, hi > lo AND unit_price = hi AND k = 1 AS is_highest, newest AND coalesce(unit_price > previous_price * 1.03, FALSE) AS above_previous,
                   newest AND unit_price > mean * 1.03 AS above_average, newest AND coalesce(from_supplier <> supplier_name, FALSE) AS switched FROM m
        ) SELECT * FROM l WHERE is_best OR is_highest OR above_previous OR above_average OR switched""",
    "compact_trend": f"""
        WITH {LINES}, w AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY chrono DESC, invoice_id DESC, line_number DESC, supplier_id DESC, quantity DESC, total DESC, discount DESC, tax DESC) AS k FROM pl WHERE {since(90)}),
        g AS (SELECT ingredient_id, count(*) AS n, max(unit_price) FILTER (k = 1) AS cur, max(unit_price) FILTER (k = 2) AS prior, round(sum(unit_price::DECIMAL(28, 8)), 4)::DOUBLE / count(*) AS mean, min(unit_price) AS lo, max(unit_price) AS hi FROM w GROUP BY 1)
        SELECT ingredient_id, n AS n_purchases, cur AS current, prior, mean,
               CASE WHEN n >= 2 AND (hi - lo) / lo >= 5 THEN 'volatile' WHEN cur > prior * 1.03 THEN 'recently-increased' WHEN n >= 3 AND cur > mean * 1.05 THEN 'rising' WHEN n >= 3 AND cur < mean * 0.95 THEN 'improving'
                    WHEN cur > lo + 0.001 THEN 'rising' WHEN n >= 2 THEN 'stable' END AS state FROM g""",
    "steadier_after_switch": f"""
        WITH {EVENTS}, o AS (SELECT *, coalesce(delta_pct, 0) AS mv, row_number() OVER (PARTITION BY ingredient_id ORDER BY chrono, event_id) AS k FROM eh),
        s AS (SELECT ingredient_id, event_id, from_supplier, supplier_name, k FROM o WHERE from_supplier <> supplier_name),
        b AS (SELECT s.ingredient_id, s.k, count(*) AS n, stddev_pop(o.mv) AS sd FROM s JOIN o ON o.ingredient_id = s.ingredient_id AND o.k < s.k GROUP BY 1, 2),
        a AS (SELECT s.ingredient_id, s.k, count(*) AS n, stddev_pop(o.mv) AS sd FROM s JOIN o ON o.ingredient_id = s.ingredient_id AND o.k >= s.k AND o.supplier_name = s.supplier_name GROUP BY 1, 2)
        SELECT s.ingredient_id, event_id, from_supplier, supplier_name, b.n AS n_before, a.n AS n_after, round(b.sd, 4) AS spread_before, round(a.sd, 4) AS spread_after
        FROM s JOIN b ON b.ingredient_id = s.ingredient_id AND b.k = s.k JOIN a ON a.ingredient_id = s.ingredient_id AND a.k = s.k WHERE b.n >= 2 AND a.n >= 2 AND b.sd >= 4 AND a.sd <= b.sd * 0.55 AND a.sd <= 2.5""",
    "supplier_signals": f"""
        WITH {HISTORY}, w AS (SELECT supplier_name, avg(delta_pct) AS m, stddev_pop(delta_pct) AS sd, count(delta_pct) AS n FROM ph WHERE {since(90)} GROUP BY 1),
        t AS (SELECT supplier_name, trend FROM ({ORACLE_SQL['supplier_temporal_trend']}))
        SELECT w.supplier_name, n AS n_events, round(m, 4) AS avg_pct, round(sd, 4) AS spread, trend,
               CASE WHEN abs(m) < 2 AND n >= 2 AND trend = 'easing' AND sd >= 4 THEN 'stabilizing_after_volatility' WHEN abs(m) < 2 AND n >= 2 AND sd <= 1.5 THEN 'improving_consistency' WHEN abs(m) < 2 AND n >= 2 THEN 'stable_pricing'
                    WHEN m >= 2 AND (trend = 'accelerating' OR n >= 2) THEN 'sustained_increase' WHEN trend = 'easing' AND abs(m) >= 2 THEN 'stabilizing_after_volatility' WHEN m >= 2 THEN 'sustained_increase' ELSE 'stable_pricing' END AS signal
        FROM w JOIN t ON t.supplier_name = w.supplier_name""",
    "ingredient_decisions": f"""
        WITH RECURSIVE {HISTORY}, {KITCHEN.strip()}, n AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY chrono DESC, invoice_id DESC, line_number DESC, supplier_id DESC, quantity DESC, total DESC, discount DESC, tax DESC) AS k FROM ph),
        f AS (SELECT e.ingredient_id, share_pct, monthly, n_recipes, delta_pct, greatest(floor(epoch((SELECT d FROM last_day) - chrono) / 86400), 0) AS age, (SELECT count(DISTINCT supplier_name) FROM pl WHERE pl.ingredient_id = e.ingredient_id) AS ns
              FROM expo e LEFT JOIN n ON n.ingredient_id = e.ingredient_id AND n.k = 1),
        b AS (SELECT *, coalesce(share_pct > 60, FALSE)::INTEGER + coalesce(delta_pct > 10, FALSE)::INTEGER + coalesce(age > 45, FALSE)::INTEGER + (ns = 1)::INTEGER + (n_recipes >= 3)::INTEGER AS bumps, monthly * 0.001 AS impact FROM f),
        s AS (SELECT *, CASE least(bumps, 3) WHEN 0 THEN 'info' WHEN 1 THEN 'watch' WHEN 2 THEN 'high' ELSE 'critical' END AS severity FROM b),
        p AS (SELECT *, CASE WHEN severity = 'critical' OR impact >= 250 OR share_pct >= 70 THEN 'critical' WHEN severity = 'high' OR impact >= 75 OR share_pct >= 60 THEN 'warning' WHEN severity = 'watch' OR impact >= 25 OR share_pct >= 55 THEN 'monitor' ELSE 'informational' END AS priority FROM s)
        SELECT ingredient_id, severity, priority, CASE WHEN priority = 'critical' THEN 'now' WHEN priority = 'warning' AND impact >= 50 THEN 'now' WHEN age > 45 THEN 'monitor' WHEN priority IN ('warning', 'monitor') THEN 'monitor' WHEN impact < 10 THEN 'background' ELSE 'monitor' END AS tier FROM p""",
    "recommendations": f"""
        WITH RECURSIVE {KITCHEN}, c AS (SELECT mar.recipe_id AS candidate_id, p_name AS dedupe_key, split_part(p_name, ' ', -1) AS title, round(65 - margin_pct, 4) AS impact FROM mar JOIN part ON p_partkey = mar.recipe_id WHERE margin_pct < 65),
        a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY impact DESC, candidate_id) AS k FROM c) WHERE k = 1),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY impact DESC, candidate_id) AS j FROM a) WHERE j = 1)
        SELECT candidate_id, dedupe_key, title, impact FROM b ORDER BY impact DESC, candidate_id LIMIT 10""",
    "alerts_merged": f"""
        WITH l AS ({ORACLE_SQL['alert_below_target']}), h AS ({ORACLE_SQL['alert_concentration']})
        SELECT * FROM l UNION ALL SELECT * FROM h WHERE subject_id NOT IN (SELECT subject_id FROM l)""",
    "visit_changes": f"""
        WITH {LINES}, c AS (SELECT supplier_name AS name, count(*) FILTER ({since(30)}) AS now, count(*) FILTER (NOT {since(30)}) AS "then" FROM pl WHERE {since(60)} GROUP BY 1)
        SELECT name, now, "then", now - "then" AS change FROM c""",
    "monetary_binding": f"""
        WITH v AS (SELECT id, quantity AS n, gross_unit_price AS gross, discount_pct AS off, line_total_net AS net, unit_price AS price, total FROM ({texts.PRINTED_SQL}) AS p), d AS (SELECT *, CASE WHEN gross IS NOT NULL AND off IS NOT NULL THEN round(gross * (1 - off / 100), 2) ELSE gross END AS derived FROM v)
        SELECT id, (CASE WHEN gross IS NULL AND off IS NOT NULL AND abs(price - off) < 0.01 AND n > 0 AND coalesce(net, total) IS NOT NULL THEN coalesce(net, total) / n
                              WHEN n = 1 AND abs(n * gross * (1 - off / 100) - net) > 0.05 THEN net ELSE coalesce(derived, price) END)::DOUBLE AS unit_price, coalesce(net, total)::DOUBLE AS total FROM d""",
    "subtotal_repair": f"""
        WITH v AS ({texts.SUBTOTAL_SQL}), g AS (SELECT *, round(net_subtotal - sum(total) OVER (PARTITION BY invoice_id), 2) AS gap FROM v),
        f AS (SELECT *, coalesce((abs(gap - 0.5) < 0.01 OR abs(gap - 1) < 0.01) AND quantity = 1 AND abs(unit_price - total) < 0.01 AND unit_price < 10 AND gap / unit_price <= 0.12, FALSE) AS fits FROM g),
        r AS (SELECT *, fits AND count(*) FILTER (fits) OVER (PARTITION BY invoice_id) = 1 AS was_repaired FROM f)
        SELECT invoice_id, line, (CASE WHEN was_repaired THEN unit_price + gap ELSE unit_price END)::DOUBLE AS unit_price, (CASE WHEN was_repaired THEN unit_price + gap ELSE total END)::DOUBLE AS total, was_repaired FROM r""",
    "footer_arithmetic": f"""
        WITH v AS (SELECT id, net_subtotal AS net, vat, total FROM ({texts.FOOTER_SQL}) AS f) SELECT id, CASE WHEN net IS NULL OR vat IS NULL OR total IS NULL THEN NULL WHEN abs(round(net + vat, 2) - total) <= 0.02 THEN 'high' ELSE 'low' END AS confidence FROM v""",
    "match_coverage": """
        WITH c AS (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)
        SELECT (SELECT count(*) FROM c WHERE n = 0) AS n_missing, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n_orphan, (SELECT count(*) FROM c WHERE n > 1) AS n_duplicate""",
}

for _name, _sql in ORACLE_SQL.items():
    if " ing AS (" in _sql and _sql.lstrip().startswith("WITH ") and not _sql.lstrip().startswith("WITH RECURSIVE"):
        ORACLE_SQL[_name] = _sql.replace("WITH ", "WITH RECURSIVE ", 1)
