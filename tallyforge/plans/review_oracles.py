"""For each review query the DuckDB SQL that must return the same rows. Written from the rules, not from the Spark plans."""

from __future__ import annotations

from tallyforge.sources import texts
from tallyforge.functions.text import COST_WORDS
from tallyforge.plans.oracles import CONTRACTS, HISTORY, KITCHEN, LINES, T, since

TD = ", ".join(f"{c} DESC" for c in T.split(", "))
_ENDS = f"""
    lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY unit_price, {T}) AS k FROM pl) WHERE k = 1),
    hi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY unit_price DESC, {T}) AS k FROM pl) WHERE k = 1)"""
_GUARDED = f"""
    gl AS (SELECT *, lag(unit_price) OVER w AS pp, lag(family) OVER w AS pf, lag(preservation) OVER w AS pv, lag(contract) OVER w AS pc FROM ct WINDOW w AS (PARTITION BY ingredient_id ORDER BY {T})),
    gr AS (SELECT *, pf <> family OR (pv <> 'unknown' AND preservation <> 'unknown' AND pv <> preservation) OR greatest(pp, unit_price) / least(pp, unit_price) > 14
                  OR (pc <> contract AND greatest(pp, unit_price) / least(pp, unit_price) > 2) AS broken, row_number() OVER (PARTITION BY ingredient_id ORDER BY {TD}) AS back FROM gl),
    tr AS (SELECT * FROM gr WHERE back = 1 AND pp IS NOT NULL AND NOT broken)"""
_STATUS = "CASE WHEN l_suppkey % 5 = 0 THEN 'unmatched' WHEN l_suppkey % 7 = 0 THEN 'suggested' ELSE 'confirmed' END"

ORACLE_SQL: dict[str, str] = {
    "price_trend_points": f"""
        WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY {TD}) AS k FROM pl),
        t AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY {T}) AS point FROM n WHERE k <= 10)
        SELECT ingredient_id, point::INTEGER AS point, invoice_id, supplier_name, unit_price FROM t""",
    "available_months": "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders",
    "price_extremes": f"""
        WITH {LINES}, {_ENDS} SELECT lo.ingredient_id, lo.unit_price AS low_price, hi.unit_price AS high_price, lo.supplier_name AS low_supplier, hi.supplier_name AS high_supplier
        FROM lo JOIN hi ON lo.ingredient_id = hi.ingredient_id""",
    "alert_recipe_deterioration": f"""
        WITH RECURSIVE {KITCHEN}, nown AS (SELECT recipe_id, sum(line_cost * CASE WHEN ingredient_id % 10 = 0 THEN 1.1 ELSE 1 END) AS cost FROM direct GROUP BY 1),
        ncost AS (SELECT root AS recipe_id, sum(batches * nown.cost) AS new_cost FROM clo JOIN nown ON nown.recipe_id = clo.recipe_id GROUP BY 1),
        w AS (SELECT r.recipe_id, (new_cost - total_cost) / selling_price * 100 AS margin_drop, greatest(new_cost - total_cost, 0) AS cost_up
              FROM rec r JOIN cost c ON r.recipe_id = c.recipe_id JOIN ncost n ON n.recipe_id = r.recipe_id WHERE r.type = 'dish')
        SELECT recipe_id, round(margin_drop, 4) AS margin_drop, round(cost_up, 4) AS cost_up,
               CASE WHEN margin_drop >= 4 OR cost_up >= 1.2 THEN 'high' WHEN margin_drop >= 2.2 OR cost_up >= 0.55 THEN 'medium' ELSE 'low' END AS severity
        FROM w WHERE margin_drop >= 1.2 OR cost_up >= 0.35 ORDER BY round(w.margin_drop, 6) DESC, round(w.cost_up, 6) DESC, recipe_id LIMIT 10""",
    "alert_volatile_basket": f"""
        WITH RECURSIVE {LINES}, {KITCHEN.strip()}, v AS (SELECT ingredient_id, count(*) AS n FROM pl WHERE {since(90)} GROUP BY 1 HAVING count(*) >= 4 ORDER BY n DESC, ingredient_id LIMIT 12)
        SELECT count(*) AS n_volatile, max(n) AS most_changes, (SELECT count(DISTINCT recipe_id) FROM edges WHERE ingredient_id IN (SELECT ingredient_id FROM v)) AS n_recipes,
               CASE WHEN max(n) >= 10 THEN 'medium' ELSE 'low' END AS severity FROM v HAVING count(*) > 0""",
    "supplier_intelligence": f"""
        WITH {CONTRACTS}, a AS (SELECT *, first_value(contract) OVER (PARTITION BY ingredient_id ORDER BY {TD}) AS anchor FROM ct),
        n AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY {TD}) AS k FROM a WHERE contract = anchor),
        g AS (SELECT ingredient_id, max(unit_price) FILTER (k = 1) AS latest, avg(unit_price) FILTER ({since(90)}) AS mean_90, min(unit_price) FILTER ({since(90)}) AS low,
                     count(*) FILTER (k <= 12) AS nr, stddev_pop(unit_price) FILTER (k <= 12) / avg(unit_price) FILTER (k <= 12) AS cv FROM n GROUP BY 1),
        s AS (SELECT n.ingredient_id, min(supplier_name) AS low_supplier FROM n JOIN g ON g.ingredient_id = n.ingredient_id AND unit_price = low WHERE {since(90)} GROUP BY 1),
        p AS (SELECT g.*, low_supplier, CASE WHEN latest > mean_90 * 1.02 THEN floor(round((latest / mean_90 - 1) * 100, 6) + 0.5)::BIGINT END AS spike_pct,
                     CASE WHEN latest > low * 1.02 THEN floor(round((latest / low - 1) * 100, 6) + 0.5)::BIGINT END AS gap_pct FROM g LEFT JOIN s ON s.ingredient_id = g.ingredient_id)
        SELECT ingredient_id, round(latest, 4) AS latest, round(mean_90, 4) AS mean_90, spike_pct, CASE WHEN gap_pct >= 2 THEN low_supplier END AS better_supplier, gap_pct, coalesce(nr >= 3 AND cv < 0.06, FALSE) AS is_stable FROM p""",
    "ingredient_drill_down": f"""
        WITH RECURSIVE {LINES}, {KITCHEN.strip()}, {_ENDS.strip()},
        st AS (SELECT ingredient_id, count(*) FILTER ({since(90)}) AS n_90, count(*) AS n_180, round(sum(unit_price::DECIMAL(28, 8)) FILTER ({since(90)}), 4)::DOUBLE / nullif(count(*) FILTER ({since(90)}), 0) AS avg_90, round(sum(unit_price::DECIMAL(28, 8)), 4)::DOUBLE / count(*) AS avg_180 FROM pl WHERE {since(180)} GROUP BY 1)
        SELECT e.ingredient_id, n_recipes, monthly, share_pct, avg_90, avg_180, lo.unit_price AS low_price, hi.unit_price AS high_price,
               coalesce(n_90, 0) AS n_90, coalesce(n_180, 0) AS n_180, lo.supplier_name AS low_supplier, hi.supplier_name AS high_supplier
        FROM expo e LEFT JOIN st ON st.ingredient_id = e.ingredient_id LEFT JOIN lo ON lo.ingredient_id = e.ingredient_id LEFT JOIN hi ON hi.ingredient_id = e.ingredient_id""",
    "cost_categories": f"""
        WITH g AS (SELECT p_partkey AS id, {texts.NAME_SQL} AS name FROM part), w AS (SELECT id, string_split_regex(lower(coalesce(name, '')), '[^\\pL0-9_]+') AS ws FROM g)
        SELECT id, CASE {' '.join(f"WHEN list_has_any(ws, {known.split()!r}) THEN '{category}'" for category, known in COST_WORDS.items())} ELSE 'other' END AS category FROM w""",
    "price_history_repairs": f"""
        WITH {LINES}, b AS (SELECT invoice_id, ingredient_id, unit_price FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id, ingredient_id ORDER BY {TD}) AS k FROM pl) WHERE k = 1),
        s AS (SELECT invoice_id, ingredient_id, CASE WHEN invoice_id % 13 = 0 THEN unit_price * 1.1 ELSE unit_price END AS new_price, unit_price, invoice_id % 17 = 0 AS lost FROM b)
        SELECT invoice_id, ingredient_id, new_price, CASE WHEN lost THEN new_price ELSE unit_price END AS expected_price, NOT lost AND invoice_id % 13 = 0 AS needs_repair,
               CASE WHEN lost THEN 'ghost_no_invoice_line' END AS skip_reason FROM s WHERE lost OR invoice_id % 13 = 0""",
    "procurement_sync": f"""
        WITH RECURSIVE {LINES}, {KITCHEN.strip()}, n AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY {TD}) AS k FROM pl)
        SELECT i.ingredient_id, current_price, unit_price AS new_price FROM ing i JOIN n ON n.ingredient_id = i.ingredient_id AND k = 1 WHERE unit_price > 0 AND abs(unit_price - current_price) > 1e-6""",
    "recipe_link_audit": f"""
        WITH RECURSIVE {KITCHEN} SELECT recipe_id, ingredient_id, quantity FROM edges WHERE ingredient_id IN (SELECT p_partkey FROM part WHERE p_type = 'LARGE')""",
    "match_progress": f"""
        WITH m AS (SELECT l_orderkey AS invoice_id, {_STATUS} AS status FROM lineitem)
        SELECT invoice_id, count(*) AS n_lines, count(*) FILTER (status = 'confirmed') AS n_matched, count(*) FILTER (status = 'suggested') AS n_suggested, count(*) FILTER (status = 'unmatched') AS n_unmatched,
               bool_and(status = 'confirmed') AS is_complete FROM m GROUP BY 1""",
    "match_counts": f"""
        WITH m AS (SELECT l_partkey, {_STATUS} AS status FROM lineitem)
        SELECT p_partkey AS ingredient_id, count(l_partkey) AS n_lines FROM part LEFT JOIN m ON l_partkey = p_partkey AND status <> 'unmatched' WHERE p_type IN ('MEDIUM', 'STANDARD', 'LARGE') GROUP BY 1""",
    "match_upserts": """
        SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 = 0 THEN 'corrected' WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'suggested' END AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0""",
    "trusted_movements": f"""
        WITH {CONTRACTS}, {_GUARDED} SELECT ingredient_id, supplier_name, unit_price, pp AS previous_price FROM tr""",
    "dominant_windows": f"""
        WITH {LINES}, h AS (SELECT ingredient_id, floor(epoch((SELECT d FROM last_day) - chrono) / 86400) AS days FROM pl WHERE {since(180)}),
        w AS (SELECT ingredient_id, CASE WHEN days < 30 THEN 0 WHEN days < 90 THEN 1 ELSE 2 END AS place, count(*) AS n FROM h GROUP BY 1, 2),
        b AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY n DESC, place) AS k FROM w)
        SELECT ingredient_id, CASE place WHEN 0 THEN '30 days' WHEN 1 THEN '3 months' ELSE '6 months' END AS "window", n AS n_purchases FROM b WHERE k = 1""",
    "concentration_groups": f"""
        WITH RECURSIVE {KITCHEN}, o AS (SELECT component_id, count(*) AS n, avg(share_pct) AS s FROM tops WHERE share_pct >= 55 AND kind = 'ingredient' GROUP BY 1)
        SELECT split_part(name, ' ', -1) AS story, count(*) AS n_ingredients, sum(n)::BIGINT AS n_recipes, round(avg(s), 4) AS avg_share_pct FROM o JOIN ing ON ing.ingredient_id = component_id GROUP BY 1""",
    "alerts_local": f"""
        WITH RECURSIVE {CONTRACTS}, {_GUARDED.strip()}, {KITCHEN.strip()},
        us AS (SELECT ingredient_id, count(DISTINCT recipe_id) AS n FROM edges WHERE ingredient_id IS NOT NULL GROUP BY 1),
        mv AS (SELECT tr.ingredient_id, unit_price, pp, (unit_price / pp - 1) * 100 AS pct, coalesce(us.n, 0) AS n FROM tr JOIN ing ON ing.ingredient_id = tr.ingredient_id LEFT JOIN us ON us.ingredient_id = tr.ingredient_id),
        fr AS (SELECT i.ingredient_id, floor(epoch((SELECT d FROM last_day) - max(chrono)) / 86400) AS days, max(chrono) AS newest FROM ing i LEFT JOIN pl ON pl.ingredient_id = i.ingredient_id GROUP BY 1),
        e AS (
            SELECT 'price_increase' AS kind, ingredient_id AS subject_id, CASE WHEN pct >= 15 THEN 'critical' WHEN pct >= 5 THEN 'high' ELSE 'watch' END AS severity, 10000 + pct * 100 + n AS priority FROM mv WHERE unit_price > pp
            UNION ALL SELECT 'price_decrease', ingredient_id, 'positive', 3000 + abs(pct) FROM mv WHERE unit_price < pp
            UNION ALL SELECT 'recipe_below_target', recipe_id, CASE WHEN margin_pct < 55 THEN 'critical' ELSE 'watch' END, 9000 + (65 - margin_pct) * 100 FROM mar WHERE margin_pct < 65
            UNION ALL SELECT 'cost_concentration', recipe_id, CASE WHEN share_pct >= 70 THEN 'watch' ELSE 'info' END, 5000 + share_pct FROM tops WHERE share_pct >= 55
            UNION ALL SELECT 'prep_cascade', sub_recipe_id, CASE WHEN count(DISTINCT recipe_id) >= 3 THEN 'watch' ELSE 'info' END, 4000 + count(DISTINCT recipe_id) * 100 FROM edges WHERE sub_recipe_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT recipe_id) >= 2
            UNION ALL SELECT * FROM (SELECT 'stale_price', us.ingredient_id, 'info', 1000 + n * 10 + coalesce(days, 45) FROM us JOIN fr ON fr.ingredient_id = us.ingredient_id WHERE days IS NULL OR days >= 45 ORDER BY n DESC, us.ingredient_id LIMIT 4)
            UNION ALL SELECT 'recent_update', ingredient_id, 'info', 500 FROM fr WHERE newest >= (SELECT d FROM last_day) - INTERVAL 7 DAY AND ingredient_id NOT IN (SELECT ingredient_id FROM mv WHERE unit_price <> pp)
        )
        SELECT kind, subject_id, severity, round(priority, 4)::DOUBLE AS priority FROM e
        ORDER BY list_position(['critical', 'high', 'watch', 'info', 'positive'], severity), round(e.priority, 4) DESC, kind, subject_id LIMIT 16""",
    "menu_dependencies": f"""
        WITH RECURSIVE {KITCHEN}, sl AS (SELECT split_part(name, ' ', -1) AS category, sum(share_pct) AS share_pct FROM expo JOIN ing ON ing.ingredient_id = expo.ingredient_id GROUP BY 1),
        e AS (
            SELECT * FROM (SELECT 0 AS step, 'shared_ingredient' AS kind, ingredient_id::VARCHAR AS subject, n_recipes::DOUBLE AS weight FROM expo WHERE n_recipes >= 2 ORDER BY n_recipes DESC, ingredient_id LIMIT 4)
            UNION ALL SELECT * FROM (SELECT 1, 'category_concentration', category, share_pct FROM sl ORDER BY share_pct DESC, category LIMIT 1) WHERE share_pct >= 25
            UNION ALL SELECT 2, 'recipe_margin_lever', tops.recipe_id::VARCHAR, share_pct FROM tops JOIN rec ON rec.recipe_id = tops.recipe_id WHERE share_pct >= 55 AND type = 'dish'
        ) SELECT kind, subject, round(weight, 4) AS weight FROM e ORDER BY step, round(e.weight, 6) DESC, length(subject), subject LIMIT 8""",
    "margin_pressure_summary": f"""
        WITH RECURSIVE {HISTORY}, {KITCHEN.strip()}, n AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY {TD}) AS k FROM ph),
        a AS (SELECT e.ingredient_id, round(monthly * delta_pct / 100, 4) AS added FROM expo e JOIN n ON n.ingredient_id = e.ingredient_id AND k = 1 WHERE delta_pct > 0 AND {since(30)})
        SELECT (SELECT count(*) FROM mar WHERE margin_pct < 65) AS n_below_target, round(coalesce(sum(added), 0), 2)::DOUBLE AS pressure, (SELECT ingredient_id FROM a ORDER BY added DESC, ingredient_id LIMIT 1) AS driver, count(*) AS n_risen FROM a""",
}
