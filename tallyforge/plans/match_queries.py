"""Matching queries over every name that a supplier writes; each with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import containment, matching, quality
from tallyforge.sources import texts, views
from tallyforge.sources.views import INGREDIENT_TYPES, table


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key: of every distinct text. Texts are made before the exchange and read behind it: one stage of both is code too long for the virtual machine to compile."""
    return texts.written_texts(spark, sf_dir).select(text.canonical_key(F.col("text")).alias("key"))


def _keyed(names: DataFrame) -> DataFrame:
    return names.select("*", text.canonical_key(F.col("text")).alias("key"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where(F.col("p_type").isin(*INGREDIENT_TYPES))
    return part.select(F.col("p_partkey").alias("ingredient_id"), F.expr(f"concat(p_name, ' ', {texts.BRAND_SQL})").alias("key"))


def alias_fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a confirmed alias of their supplier is within two edits of."""
    names = views.saved(texts.written_names(spark, sf_dir), "names")
    return matching.fuzzy_aliases(_keyed(names), texts.written_aliases(spark, sf_dir, names).where("confirmed"))


def alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.alias_collisions(texts.written_aliases(spark, sf_dir))


def ownership_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that different suppliers take for different entries."""
    known = texts.written_aliases(spark, sf_dir).where(F.col("supplier_name") != "")
    found = known.groupBy("normalized_alias").agg(F.countDistinct("ingredient_id").alias("n_ingredients"), F.countDistinct("supplier_name").alias("n_suppliers"))
    return found.where((F.col("n_ingredients") >= 2) & (F.col("n_suppliers") >= 2))


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name with the entries that it shares half its weight with, and what the score is made of."""
    return matching.similar_entries(_keys(spark, sf_dir), _catalog(spark, sf_dir))


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of every name that a supplier writes. Every third house blend was named by a user; of plain names each tenth part was rejected."""
    # the line's id is made of two others, so it is not written
    names = views.saved(texts.keyed_names(spark, sf_dir), "names").withColumn("line_id", F.col("part_id") * 1_000_000 + F.col("supplier_id"))
    own = names.where("is_entry").select("form", "part_id", "supplier_name", "key", F.col("part_id").alias("ingredient_id"))
    named = own.where("form = 7 AND part_id % 3 = 0").groupBy("supplier_name", "key").agg(F.min("ingredient_id").alias("ingredient_id"))
    refused = own.where("form = 0 AND part_id % 10 = 0").select("supplier_name", "key", "ingredient_id")
    return matching.cascade(names.select("line_id", "supplier_name", "key"), _catalog(spark, sf_dir), texts.written_aliases(spark, sf_dir, names).where("confirmed"), named, refused)


def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name that a supplier writes with the names that hold all its words."""
    # written, as a filter on keys would be pushed below the distinct texts, and keys are read several times
    return containment.contained(views.saved(_keys(spark, sf_dir).select(F.col("key").alias("name")).distinct(), "keys"))


def hidden_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that no recipe uses and whose name lies in a used entry's; each fourth entry still has its short, legacy name."""
    part = table(spark, sf_dir, "part").where(F.col("p_type").isin(*INGREDIENT_TYPES))
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.expr(f"concat(p_name, ' ', {texts.BRAND_SQL})"))
    uses = views.recipe_edges(spark, sf_dir).where(F.col("ingredient_id").isNotNull()).groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n_uses"))
    entries = part.select(F.col("p_partkey").alias("ingredient_id"), name.alias("name")).join(uses.hint("merge"), "ingredient_id", "left").fillna({"n_uses": 0})
    # read eight times by what follows; the uses are counted once
    return containment.hidden_orphans(views.saved(entries, "entries"))


_KEY = "CASE v WHEN 4 THEN name WHEN 7 THEN 'house blend' ELSE written END"
NAMES = f"""
    pr AS (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS s_suppkey FROM lineitem),
    wn AS (
        SELECT p_partkey * 1000000 + s_suppkey AS line_id, p_partkey, s_suppkey, lower(s_name) AS supplier_name, (p_partkey + 3 * s_suppkey) % 8 AS v, concat(p_name, ' ', {texts.BRAND_SQL.replace('AS STRING', 'AS VARCHAR')}) AS name, p_name AS short,
               concat({texts.WRITTEN_SQL.replace('AS STRING', 'AS VARCHAR')}, {texts.GRATED_SQL}) AS written, p_type IN ('MEDIUM', 'STANDARD', 'LARGE') AS is_entry
        FROM pr JOIN part USING (p_partkey) JOIN supplier USING (s_suppkey)
    ), ln AS (SELECT *, {_KEY} AS key FROM wn),
    al AS (
        SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN '' ELSE supplier_name END AS supplier_name, 'promo ' || name AS alias, p_partkey AS ingredient_id, TRUE AS confirmed FROM wn WHERE is_entry AND v = 1
        UNION SELECT supplier_name, name, p_partkey, p_partkey % 2 = 0 FROM wn WHERE is_entry AND v = 2
        UNION SELECT supplier_name, short, p_partkey, TRUE FROM wn WHERE is_entry AND v = 6 AND s_suppkey % 3 = 0
    ), cat AS (SELECT p_partkey AS ingredient_id, concat(p_name, ' ', {texts.BRAND_SQL.replace('AS STRING', 'AS VARCHAR')}) AS key FROM part WHERE p_type IN ('MEDIUM', 'STANDARD', 'LARGE'))"""
_FUZZY = """
    fq AS (SELECT DISTINCT supplier_name, key, split_part(key, ' ', 1) AS head, replace(substr(key, instr(key, ' ') + 1), ' ', '') AS fp FROM ln WHERE contains(key, ' ')),
    fa AS (SELECT supplier_name, ingredient_id, split_part(alias, ' ', 1) AS head, replace(substr(alias, instr(alias, ' ') + 1), ' ', '') AS fp FROM al WHERE confirmed AND supplier_name <> ''),
    fd AS (SELECT q.supplier_name, q.key, ingredient_id, levenshtein(q.fp, a.fp) AS d FROM fq q JOIN fa a ON a.supplier_name = q.supplier_name AND a.head = q.head WHERE length(q.fp) >= 4 AND length(a.fp) >= 4),
    fl AS (SELECT *, min(d) OVER (PARTITION BY supplier_name, key) AS least FROM fd WHERE d <= 2),
    fz AS (SELECT supplier_name, key, min(ingredient_id) AS ingredient_id, min(d)::INTEGER AS distance FROM fl WHERE d = least GROUP BY 1, 2 HAVING min(ingredient_id) = max(ingredient_id))"""
_SCORED = """
    ct AS (SELECT ingredient_id, key, unnest(list_distinct(string_split(key, ' '))) AS word FROM cat),
    nn AS (SELECT count(*) AS n FROM cat),
    wt AS (SELECT word, floor(1000 * ln(1 + (SELECT n FROM nn) / count(*)))::BIGINT AS w FROM ct GROUP BY 1),
    lt AS (SELECT key, word, coalesce(w, floor(1000 * ln(1 + (SELECT n FROM nn)))::BIGINT) AS w FROM (SELECT key, unnest(list_distinct(string_split(key, ' '))) AS word FROM (SELECT DISTINCT key FROM ln)) LEFT JOIN wt USING (word)),
    lw AS (SELECT key, sum(w) AS whole FROM lt GROUP BY 1), cw AS (SELECT ingredient_id, any_value(key) AS key, sum(w) AS whole FROM ct JOIN wt USING (word) GROUP BY 1),
    cm AS (SELECT lt.key, ct.ingredient_id, sum(w)::BIGINT AS common FROM lt JOIN ct USING (word) GROUP BY 1, 2),
    ov AS (SELECT cm.key, cm.ingredient_id, cw.key AS other, common, lw.whole + cw.whole - common AS every FROM cm JOIN lw ON lw.key = cm.key JOIN cw ON cw.ingredient_id = cm.ingredient_id
           WHERE 2 * common >= lw.whole + cw.whole - common AND NOT contains(cm.key, 'ralado')),
    bg AS (SELECT t, substr(t, i, 2) AS g, count(*) AS n FROM (SELECT DISTINCT key AS t FROM ov UNION SELECT DISTINCT other FROM ov), unnest(range(1, length(t))) AS u(i) GROUP BY 1, 2),
    dc AS (SELECT ov.key, other, sum(least(x.n, y.n)) AS pairs FROM (SELECT DISTINCT key, other FROM ov) ov JOIN bg x ON x.t = ov.key JOIN bg y ON y.t = ov.other AND y.g = x.g GROUP BY 1, 2),
    sc AS (SELECT ov.key, ingredient_id, (common / every)::DOUBLE AS overlap, CASE WHEN ov.key = ov.other THEN 1.0 ELSE (2.0::DOUBLE * pairs / (length(ov.key) + length(ov.other) - 2)) END::DOUBLE AS dice
           FROM ov JOIN dc ON dc.key = ov.key AND dc.other = ov.other),
    ss AS (SELECT *, 0.6::DOUBLE * overlap + 0.4::DOUBLE * dice AS score FROM sc)"""

ORACLE_SQL: dict[str, str] = {
    "contained_names": f"""
        WITH {NAMES}, k AS (SELECT DISTINCT key AS name, string_split(key, ' ') AS ws FROM ln)
        SELECT a.name, b.name AS other FROM k a JOIN k b ON a.name <> b.name AND contains(b.name, a.ws[1]) AND contains(b.name, a.ws[-1]) AND len(list_filter(a.ws, lambda w: NOT contains(b.name, w))) = 0""",
    "alias_fuzzy_join": f"WITH {NAMES}, {_FUZZY.strip()} SELECT * FROM fz",
    "alias_collisions": f"WITH {NAMES} SELECT supplier_name, alias AS normalized_alias, count(DISTINCT ingredient_id) AS n_ingredients, min(ingredient_id) AS least_id FROM al GROUP BY 1, 2 HAVING count(DISTINCT ingredient_id) >= 2",
    "ownership_collisions": f"""
        WITH {NAMES} SELECT alias AS normalized_alias, count(DISTINCT ingredient_id) AS n_ingredients, count(DISTINCT supplier_name) AS n_suppliers FROM al WHERE supplier_name <> ''
        GROUP BY 1 HAVING count(DISTINCT ingredient_id) >= 2 AND count(DISTINCT supplier_name) >= 2""",
    "similar_names": f"WITH {NAMES}, {_SCORED.strip()} SELECT key, ingredient_id, overlap, dice, score FROM ss",
    "match_cascade": f"""
        WITH {NAMES}, {_FUZZY.strip()}, {_SCORED.strip()},
        ak AS (SELECT supplier_name, alias, min(ingredient_id) AS ingredient_id FROM al WHERE confirmed GROUP BY 1, 2 HAVING count(DISTINCT ingredient_id) = 1),
        e AS (
            SELECT supplier_name, key, min(p_partkey) AS ingredient_id, 'override' AS kind, 1.0::DOUBLE AS score, 0 AS stage FROM ln WHERE is_entry AND v = 7 AND p_partkey % 3 = 0 GROUP BY 1, 2
            UNION ALL SELECT DISTINCT ln.supplier_name, key, ak.ingredient_id, 'alias', 1.0, 1 FROM ln JOIN ak ON ak.supplier_name = ln.supplier_name AND ak.alias = key
            UNION ALL SELECT DISTINCT ln.supplier_name, key, ak.ingredient_id, 'global_alias', 1.0, 2 FROM ln JOIN ak ON ak.supplier_name = '' AND ak.alias = key
            UNION ALL SELECT supplier_name, key, ingredient_id, 'fuzzy_alias', 1.0, 3 FROM fz
            UNION ALL SELECT DISTINCT supplier_name, ln.key, cat.ingredient_id, 'exact', 1.0, 4 FROM ln JOIN cat ON cat.key = ln.key
            UNION ALL SELECT DISTINCT supplier_name, ln.key, ss.ingredient_id, CASE WHEN score >= 0.72 THEN 'semantic' ELSE 'operational' END, score, 5 FROM ln JOIN ss ON ss.key = ln.key WHERE score >= 0.58
        ), k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM ln WHERE is_entry AND v = 0 AND p_partkey % 10 = 0 AND ln.supplier_name = e.supplier_name AND ln.key = e.key AND p_partkey = e.ingredient_id)),
        b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY supplier_name, key ORDER BY stage, round(score, 9) DESC, ingredient_id) = 1)
        SELECT line_id, b.ingredient_id, coalesce(kind, 'unmatched') AS kind, coalesce(score, 0)::DOUBLE AS score FROM ln LEFT JOIN b ON b.supplier_name = ln.supplier_name AND b.key = ln.key""",
}
