"""Queries over what is recorded and what services send; each with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import impact_store, payloads
from tallyforge.plans.oracles import KITCHEN
from tallyforge.plans.queries import _kitchen
from tallyforge.sources import texts, views

RUNS = 3


def scan_payload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every payload of the recognition service, rejected ones among them."""
    return payloads.lines(texts.scan_payloads(spark, sf_dir))


def scan_payload_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many payload items were rejected, and why."""
    return payloads.lines(texts.scan_payloads(spark, sf_dir)).where(F.col("rejected").isNotNull()).groupBy("rejected").agg(F.count(F.lit(1)).alias("n_items"))


def _recorded(spark: SparkSession, sf_dir: str) -> impact_store.ImpactStore:
    """Three runs, each of which moves other ingredients by more; the first is recorded twice."""
    edges, made, catalog = _kitchen(spark, sf_dir)
    store = impact_store.ImpactStore(views.shared_folder(spark, "impacts"))
    for run in (*range(1, RUNS + 1), 1):
        pct = F.when(F.col("ingredient_id") % (2 + run) == 0, F.lit(5.0 * run))
        store.record(impact_store.direct_impacts(edges, made, catalog, pct), run)
    return store


def margin_impacts_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest recorded impact of every dish and ingredient."""
    return _recorded(spark, sf_dir).newest(spark)


def margin_impact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run recorded."""
    rows = _recorded(spark, sf_dir).history(spark)
    return rows.groupBy("run", "impact").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("recipe_id").alias("n_recipes"), F.max("margin_drop").alias("largest_drop"))


_IMPACTS = f"""{KITCHEN},
    im AS (
        SELECT r.recipe_id, d.ingredient_id, k::INTEGER AS run, line_cost * (5.0::DOUBLE * k) / 100 AS cost_up, line_cost * (5.0::DOUBLE * k) / 100 / selling_price * 100 AS margin_drop
        FROM direct d JOIN rec r ON r.recipe_id = d.recipe_id, (VALUES (1), (2), (3)) AS v(k) WHERE r.type = 'dish' AND d.ingredient_id % (2 + k) = 0 AND line_cost IS NOT NULL
    ), mx AS (SELECT *, CASE WHEN margin_drop > 5 THEN 'HIGH' WHEN margin_drop > 2 THEN 'MEDIUM' ELSE 'LOW' END AS impact FROM im
              QUALIFY row_number() OVER (PARTITION BY run, recipe_id, ingredient_id ORDER BY margin_drop DESC, cost_up DESC) = 1)"""
_PAYLOADS = f"""
    p AS ({texts.PAYLOAD_SQL.replace('AS STRING', 'AS VARCHAR')}), j AS (SELECT id, payload, json_valid(payload) AS sound FROM p),
    i AS (SELECT id, sound, unnest(CASE WHEN NOT sound THEN [NULL] WHEN payload LIKE '[%' THEN json_extract(payload, '$[*]') ELSE [payload::JSON] END) AS it,
                 unnest(range(0, CASE WHEN sound AND payload LIKE '[%' THEN json_array_length(payload)::BIGINT ELSE 1 END)) AS item FROM j),
    f AS (SELECT id, item::INTEGER AS item, sound, trim(it ->> '$.name') AS name, coalesce(try_cast(replace(it ->> '$.quantity', ',', '.') AS DOUBLE), 1) AS quantity, coalesce(nullif(trim(it ->> '$.unit'), ''), 'un') AS unit,
                 try_cast(replace(it ->> '$.unit_price', ',', '.') AS DOUBLE) AS unit_price, try_cast(replace(it ->> '$.total', ',', '.') AS DOUBLE) AS total FROM i),
    g AS (SELECT *, CASE WHEN NOT sound THEN 'torn' WHEN coalesce(name, '') = '' THEN 'unnamed' END AS rejected FROM f)"""

ORACLE_SQL: dict[str, str] = {
    "scan_payload_lines": f"""
        WITH {_PAYLOADS} SELECT id, item, CASE WHEN rejected IS NULL THEN name END AS name, CASE WHEN rejected IS NULL THEN quantity END AS quantity, CASE WHEN rejected IS NULL THEN unit END AS unit,
               CASE WHEN rejected IS NULL THEN unit_price END AS unit_price, CASE WHEN rejected IS NULL THEN coalesce(total, quantity * unit_price) END AS total, rejected FROM g""",
    "scan_payload_rejects": f"WITH {_PAYLOADS} SELECT rejected, count(*) AS n_items FROM g WHERE rejected IS NOT NULL GROUP BY 1",
    "margin_impacts_newest": f"WITH RECURSIVE {_IMPACTS} SELECT recipe_id, ingredient_id, run, cost_up, margin_drop, impact FROM mx QUALIFY row_number() OVER (PARTITION BY recipe_id, ingredient_id ORDER BY run DESC) = 1",
    "margin_impact_history": f"WITH RECURSIVE {_IMPACTS} SELECT run, impact, count(*) AS n_rows, count(DISTINCT recipe_id) AS n_recipes, max(margin_drop) AS largest_drop FROM mx GROUP BY 1, 2",
}
