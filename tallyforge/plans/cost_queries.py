"""Queries over conversions between what a recipe uses and what is bought; each with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import packs, units, weights
from tallyforge.functions.numbers import exact_sum
from tallyforge.operators import extraction, line_costs, recipes
from tallyforge.plans.oracles import KITCHEN, PHRASES
from tallyforge.plans.queries import _kitchen, r4
from tallyforge.sources import texts

LINE_UNITS = ("g", "ml", "un", "kg", "L", None, "box")


def countable_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by weight or volume of goods that are bought by the piece."""
    rows = texts.conversions(spark, sf_dir)
    return rows.select("id", units.countable_line_cost(F.col("amount"), F.col("pack_price"), F.col("pieces"), F.col("per_piece")).alias("cost"))


def weight_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts.weighed_names(spark, sf_dir)
    rows = rows.withColumn("grams_line", weights.line_grams(F.col("line"))).withColumn("grams_entry", weights.line_grams(F.col("entry")))
    return rows.select("id", "grams_line", "grams_entry", weights.weight_score(F.col("grams_line"), F.col("grams_entry")).alias("score"))


def quantity_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.anchored_quantities(texts.scanned_lines(spark, sf_dir)).select("id", "quantity", "anchored", "mismatch")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ingredient_id, unit_cost, priced_in, piece_grams, piece_ml, density: each third ingredient is priced by the piece, the others by what their pack holds."""
    rows = packs.read_once(texts.part_phrases(spark, sf_dir), "phrase").select("id", "price", "s")
    by_piece = F.col("id") % 3 == 0
    piece = F.col("s.usable") / (F.col("s.bought") * F.coalesce("s.inner", F.lit(1.0)))
    return rows.select(
        F.col("id").alias("ingredient_id"), F.when(by_piece, F.col("price") / (F.col("s.bought") * F.coalesce("s.inner", F.lit(1.0)))).otherwise(F.col("price") / F.col("s.usable")).alias("unit_cost"),
        F.when(by_piece, "un").otherwise(F.col("s.usable_unit")).alias("priced_in"), F.when(F.col("s.usable_unit") == "g", piece).alias("piece_grams"), F.when(F.col("s.usable_unit") == "ml", piece).alias("piece_ml"),
        F.when(F.col("id") % 5 != 0, F.lit(0.92)).alias("density"),
    )


def _lines(edges: DataFrame, priced: DataFrame) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u).cast("string") for u in LINE_UNITS]), ((F.col("recipe_id") + F.col("ingredient_id")) % len(LINE_UNITS) + 1).cast("int"))
    lines = edges.where(F.col("ingredient_id").isNotNull()).select("recipe_id", "ingredient_id", "quantity", unit.alias("unit")).join(priced, "ingredient_id", "left")
    cost = line_costs.line_cost(*[F.col(c) for c in ("quantity", "unit", "unit_cost", "priced_in", "piece_grams", "piece_ml", "density")])
    return lines.select("recipe_id", "ingredient_id", "quantity", "unit", F.explode(F.array(cost)).alias("c")).select("recipe_id", "ingredient_id", "quantity", "unit", "c.*")


def line_cost_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of every ingredient line, in whatever unit it is written, with the conversions that lead there."""
    edges, _, _ = _kitchen(spark, sf_dir)
    return _lines(edges, _priced(spark, sf_dir))


def recipe_cost_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of all recipes from converted lines, over all levels."""
    edges, made, _ = _kitchen(spark, sf_dir)
    lines = _lines(edges, _priced(spark, sf_dir)).select("recipe_id", F.col("cost").alias("line_cost"))
    return recipes.rolled_up(edges, made, None, lines=lines).select("recipe_id", *r4("total_cost"), "n_lines", "n_unresolved")


def exposure_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each ingredient costs over all direct lines, and what every ten percent on its price would add."""
    edges, _, _ = _kitchen(spark, sf_dir)
    found = _lines(edges, _priced(spark, sf_dir)).groupBy("ingredient_id").agg(exact_sum(F.col("cost")).alias("cost"), F.countDistinct("recipe_id").alias("n_recipes"), F.count_if(F.col("cost").isNull()).alias("n_unresolved"))
    return found.withColumn("ten_percent", F.col("cost") * 0.1)


_UNITS = " ".join(f"WHEN {k} THEN {'NULL' if u is None else repr(u)}" for k, u in enumerate(LINE_UNITS))
LINES = f"""{KITCHEN}, {PHRASES.strip()},
    pc AS (
        SELECT id AS ingredient_id, CASE WHEN id % 3 = 0 THEN price / (bought * coalesce("inner", 1)) ELSE price / usable END AS unit_cost, CASE WHEN id % 3 = 0 THEN 'un' ELSE usable_unit END AS priced_in,
               CASE WHEN usable_unit = 'g' THEN usable / (bought * coalesce("inner", 1)) END AS pg, CASE WHEN usable_unit = 'ml' THEN usable / (bought * coalesce("inner", 1)) END AS pm, CASE WHEN id % 5 <> 0 THEN 0.92::DOUBLE END AS density FROM ph
    ), lu AS (
        SELECT e.recipe_id, e.ingredient_id, e.quantity, CASE (e.recipe_id + e.ingredient_id) % {len(LINE_UNITS)} {_UNITS} END AS unit, unit_cost, priced_in, pg, pm, density
        FROM edges e LEFT JOIN pc ON pc.ingredient_id = e.ingredient_id WHERE e.ingredient_id IS NOT NULL
    ), la AS (SELECT *, CASE WHEN unit IN ('g', 'kg') THEN 'g' WHEN unit IN ('ml', 'L') THEN 'ml' WHEN unit = 'un' THEN 'un' END AS own, quantity * CASE WHEN unit IN ('kg', 'L') THEN 1000 ELSE 1 END AS amount FROM lu),
    lp AS (
        SELECT *, CASE WHEN coalesce(unit_cost > 0, FALSE) IS FALSE THEN 'unpriced' WHEN unit IS NULL THEN 'unitless' WHEN own = 'un' AND priced_in = 'un' THEN 'pieces' WHEN own = priced_in THEN 'same_family'
                       WHEN own = 'ml' AND priced_in = 'un' AND pm > 0 THEN 'piece_volume' WHEN own = 'g' AND priced_in = 'un' AND pg > 0 THEN 'piece_weight' WHEN own = 'un' AND priced_in = 'g' AND pg > 0 THEN 'pieces_by_weight'
                       WHEN own = 'un' AND priced_in = 'ml' AND pm > 0 THEN 'pieces_by_volume' WHEN own IN ('g', 'ml') AND priced_in IN ('g', 'ml') AND density > 0 THEN 'density' END AS path FROM la
    ), lv AS (
        SELECT *, CASE path WHEN 'unitless' THEN quantity WHEN 'pieces' THEN amount WHEN 'same_family' THEN amount WHEN 'piece_volume' THEN amount / pm WHEN 'piece_weight' THEN amount / pg WHEN 'pieces_by_weight' THEN amount * pg
                            WHEN 'pieces_by_volume' THEN amount * pm WHEN 'density' THEN CASE own WHEN 'ml' THEN amount * density ELSE amount / density END END AS converted FROM lp
    ), lc AS (SELECT *, converted * unit_cost AS cost FROM lv)"""

ORACLE_SQL: dict[str, str] = {
    "countable_costs": f"SELECT id, CASE WHEN amount >= 0 AND pack_price >= 0 AND pieces > 0 AND per_piece > 0 THEN amount / per_piece * (pack_price / pieces) END::DOUBLE AS cost FROM ({texts.CONVERSION_SQL})",
    "line_cost_paths": f"WITH RECURSIVE {LINES} SELECT recipe_id, ingredient_id, quantity, unit, path, converted, cost FROM lc",
    "recipe_cost_converted": f"""
        WITH RECURSIVE {LINES}, lo AS (SELECT recipe_id, sum(cost) AS cost, count(*) AS n, count(*) FILTER (cost IS NULL) AS o FROM lc GROUP BY 1)
        SELECT root AS recipe_id, round(sum(batches * lo.cost), 4) AS total_cost, sum(n)::BIGINT AS n_lines, sum(o)::BIGINT AS n_unresolved FROM clo JOIN lo ON lo.recipe_id = clo.recipe_id GROUP BY 1""",
    "exposure_converted": f"""
        WITH RECURSIVE {LINES}, g AS (SELECT ingredient_id, round(sum(cost::DECIMAL(28, 8)), 4)::DOUBLE AS cost, count(DISTINCT recipe_id) AS n_recipes, count(*) FILTER (cost IS NULL) AS n_unresolved FROM lc GROUP BY 1)
        SELECT *, cost * 0.1::DOUBLE AS ten_percent FROM g""",
    "weight_compatibility": f"""
        WITH w AS ({texts.WEIGHED_SQL}), t AS (SELECT id, 'line' AS side, line AS name FROM w UNION ALL SELECT id, 'entry', entry FROM w),
        p AS (SELECT id, side, regexp_replace(strip_accents(lower(name)), '[^a-z0-9\\s]+', ' ', 'g') AS x FROM t),
        g AS (SELECT id, side, list_transform(regexp_extract_all(x, '\\b[0-9]+\\s*(?:kgs?|grs?|g)\\b'), lambda m: regexp_extract(m, '[0-9]+')::DOUBLE * CASE WHEN contains(m, 'k') THEN 1000 ELSE 1 END) AS ex,
                     list_filter(list_transform(regexp_extract_all(x, '\\b[0-9]{{2,3}}\\b'), lambda m: m::DOUBLE), lambda n: n BETWEEN 20 AND 500) AS bare FROM p),
        r AS (SELECT id, side, coalesce(list_min(list_filter(ex, lambda v: v < 2000)), ex[1], list_min(bare)) AS grams FROM g),
        b AS (SELECT id, max(grams) FILTER (side = 'line') AS a, max(grams) FILTER (side = 'entry') AS c FROM r GROUP BY 1)
        SELECT id, a AS grams_line, c AS grams_entry, (CASE WHEN a IS NULL AND c IS NULL THEN 0 WHEN a IS NULL OR c IS NULL THEN -0.04 WHEN a = c THEN 0.12 WHEN abs(a - c) <= 15 OR abs(a - c) / greatest(a, c) <= 0.15 THEN 0.05
               WHEN greatest(a, c) < 500 AND (abs(a - c) > 80 OR abs(a - c) / greatest(a, c) > 0.35) THEN -0.35 WHEN greatest(a, c) >= 500 AND (abs(a - c) > 180 OR abs(a - c) / greatest(a, c) > 0.47) THEN -0.35 ELSE 0 END)::DOUBLE AS score FROM b""",
    "quantity_anchors": f"""
        WITH v AS (SELECT id, quantity AS n, ocr_quantity AS scan, unit, unit_price AS price, line_total_net AS net, discount_pct AS off FROM ({texts.SCANNED_SQL})), s AS (SELECT *, lower(unit) = 'kg' AND off IS NOT NULL AND scan <> round(scan) AS inside, round(abs(scan - n) / greatest(scan, 0.01) * 100, 2) AS apart,
              round(abs(net - scan * price), 2) AS ms, round(abs(net - n * price), 2) AS mr, greatest(abs(round(net, 2)), abs(round(n * price, 2)), 0.01) AS whole FROM v),
        a AS (SELECT *, coalesce(inside AND apart > 2 AND net IS NOT NULL AND (ms < mr - 0.1 OR (mr > 0.5 AND mr / whole * 100 > 5 AND ms <= 0.5)), FALSE) AS anchored FROM s)
        SELECT id, (CASE WHEN anchored THEN scan ELSE n END)::DOUBLE AS quantity, anchored, coalesce(inside AND apart > 10, FALSE) AND NOT anchored AS mismatch FROM a""",
}
