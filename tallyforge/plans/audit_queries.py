"""Identity of names and audits of the catalog over whole tables; each with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import identity
from tallyforge.operators import audits, clusters
from tallyforge.sources import texts

#: Parts whose shelf names are the catalog that products of invoices are held against.
_ENTRIES = "id % 17 IN (1, 9)"


def shelf_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every shelf name says: words, family, preparation, cluster, family of the kitchen with its score, kind."""
    read = identity.described(texts.shelf_names(spark, sf_dir).select("name").distinct())
    told = read.select("name", F.array_join("words", " ").alias("words"), F.array_join("expanded", " ").alias("expanded"), "family", "form", "cluster", "kitchen", "kitchen_score", identity.kind(F.lit(None).cast("string"), F.col("shorthand")).alias("kind"))
    return texts.shelf_names(spark, sf_dir).select("id", "name").join(told, "name").drop("name")


def matching_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that lines may be matched with: active ones that are no aliases, neither as given nor by name. Promotional parts are archived; each fifth part's kind is given, in capitals."""
    rows = identity.read_once(texts.shelf_names(spark, sf_dir).where("type <> 'PROMO'"), "name", shorthand="shorthand")
    given = F.when(F.col("id") % 10 == 0, " Alias ").when(F.col("id") % 10 == 5, "CANONICAL")
    told = rows.where((F.coalesce(F.lower(F.trim(given)), F.lit("")) != "alias") & ~F.col("shorthand"))
    return told.select(F.col("id").alias("ingredient_id"), "name", identity.kind(given, F.col("shorthand")).alias("kind"))


def operational_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(texts.shelf_lines(spark, sf_dir))


def synthesised_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.synthesised(operational_clusters(spark, sf_dir), texts.shelf_names(spark, sf_dir).where(_ENTRIES))


def unit_integrity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.unit_findings(texts.piece_entries(spark, sf_dir))


def unit_integrity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.unit_summary(unit_integrity_findings(spark, sf_dir))


def unit_integrity_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.repaired_units(texts.piece_entries(spark, sf_dir))


def alias_integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.alias_findings(texts.shelf_aliases(spark, sf_dir))


def alias_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that each distinct name of the even parts, written out, is nearest to among the odd parts."""
    rows = texts.shelf_names(spark, sf_dir)
    mine = identity.described(rows.where("id % 2 = 0").select("name").distinct(), ("expanded",)).select(F.array_join("expanded", " ").alias("key"))
    theirs = identity.read_once(rows.where("id % 2 = 1").groupBy("name").agg(F.min("id").alias("ingredient_id")), "name", words="words").select("ingredient_id", F.array_join("words", " ").alias("key"))
    return audits.neighbours(mine, theirs)


def _value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)


def _case(key: str, column: int, rows: tuple[tuple, ...]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {_value(row[column])}" for k, row in enumerate(rows)) + " END"


def _filled(key: str, column: int, name: str) -> str:
    return f"replace({_case(key, column, texts.SHELF_FORMS)}, '{{n}}', {name})"


_FORMS = texts.SHELF_FORMS
_N = len(_FORMS)
# The words of a part's name written out: one of them is a short word.
_OUT = "replace(p_name, 'ring', 'rings')"
_SHELF = f"sh AS (SELECT *, p_partkey % {_N} AS v FROM part)"
_CLUSTERS = f"""
    ln AS (SELECT l_orderkey AS invoice_id, (l_orderkey * 3 + (l_linenumber % 3) * 5) % {_N} AS v FROM lineitem JOIN part ON p_partkey = l_partkey),
    st AS (SELECT invoice_id, {_case("v", 3, _FORMS)} AS family, {_case("v", 4, _FORMS)} AS form, {_case("v", 5, _FORMS)} AS alias_cluster FROM ln),
    mixed AS (SELECT invoice_id FROM st WHERE family = 'cheddar' GROUP BY 1 HAVING count(DISTINCT coalesce(form, 'plain')) > 1),
    cl AS (
        SELECT invoice_id, coalesce(any_value(alias_cluster), family || '-' || form) AS cluster_id, upper(family || ' ' || replace(form, '_', ' ')) AS canonical_name, family, form, any_value(alias_cluster) AS alias_cluster, count(*) AS n_lines
        FROM st WHERE form IS NOT NULL AND NOT contains(form, '+') AND NOT (family = 'cheddar' AND invoice_id IN (SELECT invoice_id FROM mixed)) GROUP BY invoice_id, family, form
        HAVING count(*) >= 2 OR any_value(alias_cluster) IS NOT NULL)"""
_PIECES = f"""
    raw AS ({texts.PIECE_SQL.replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR").replace("0D ", "0 ").replace("5D ", "5 ")}),
    pc AS (
        SELECT *, {_case("ingredient_id % 8", 1, texts.PIECE_FORMS)} AS piece, CAST({_case("ingredient_id % 8", 2, texts.PIECE_FORMS)} AS DOUBLE) AS embedded_g, CAST({_case("ingredient_id % 8", 3, texts.PIECE_FORMS)} AS DOUBLE) AS embedded_ml,
               CASE WHEN purchase_quantity = 1000 THEN 'g' WHEN purchase_quantity > 1000 THEN 'ml' ELSE 'un' END AS inferred,
               coalesce(nullif(trim(base_unit), ''), purchase_unit, unit) IN ('g', 'ML', 'grams') AS mass
        FROM raw),
    pd AS (SELECT *, coalesce(embedded_g, embedded_ml) IS NOT NULL AS sized, coalesce(purchase_quantity = coalesce(embedded_g, embedded_ml), FALSE) AS divided FROM pc),
    fd AS (
        SELECT ingredient_id, name, concat_ws(',', CASE WHEN sized AND mass THEN 'embedded_weight_with_mass_base' END, CASE WHEN piece AND divided THEN 'gram_denominator_matches_embedded_weight' END,
               CASE WHEN piece AND mass THEN 'mass_base_on_countable_name' END, CASE WHEN piece AND inferred = 'g' THEN 'inferred_mass_base_from_pq_heuristic' END,
               CASE WHEN piece AND sized AND inferred = 'g' THEN 'countable_name_weight_family_mismatch' END) AS patterns, embedded_g, embedded_ml, purchase_quantity, inferred FROM pd)"""
_DICE = """
    bg AS (SELECT t, substr(t, i, 2) AS g, count(*) AS n FROM tx, unnest(range(1, length(t))) AS u(i) GROUP BY 1, 2),
    cm AS (SELECT x.t AS a, y.t AS b, sum(least(x.n, y.n)) AS n FROM {pairs} JOIN bg x ON x.t = p.a JOIN bg y ON y.t = p.b AND y.g = x.g GROUP BY 1, 2),
    dc AS (SELECT p.a, p.b, CASE WHEN p.a = p.b THEN 1.0 ELSE 2.0::DOUBLE * coalesce(n, 0) / (length(p.a) + length(p.b) - 2) END::DOUBLE AS dice FROM {pairs} LEFT JOIN cm ON cm.a = p.a AND cm.b = p.b)"""
# Kinds of the shelf forms that exclude each other: a forbidden pair, or one kind each and another.
_KINDS = [form[9].split() for form in _FORMS]
_FORBIDDEN = {frozenset((a, b)) for a, others in identity.APART.items() for b in others.split()}
_EXCLUDED = [(i, j) for i, a in enumerate(_KINDS) for j, b in enumerate(_KINDS) if a and b and (any(frozenset((x, y)) in _FORBIDDEN for x in a for y in b) or (len(a) == len(b) == 1 and a != b))]
_STRANGE = [(i, j) for i, a in enumerate(_KINDS) for j, b in enumerate(_KINDS) if a and b and not set(a) & set(b)]
_CORE = "[" + ", ".join(f"'{w}'" for known in identity.FOOD_WORDS.values() for w in known.split()) + "]"

ORACLE_SQL: dict[str, str] = {
    "shelf_identity": f"""
        WITH {_SHELF} SELECT p_partkey AS id, {_filled("v", 1, "p_name")} AS words, {_filled("v", 2, _OUT)} AS expanded, {_case("v", 3, _FORMS)} AS family, {_case("v", 4, _FORMS)} AS form, {_case("v", 5, _FORMS)} AS cluster,
               {_case("v", 6, _FORMS)} AS kitchen, CAST({_case("v", 7, _FORMS)} AS DOUBLE) AS kitchen_score, {_case("v", 8, _FORMS)} AS kind FROM sh""",
    "matching_catalog": f"""
        WITH {_SHELF} SELECT p_partkey AS ingredient_id, replace({_case("v", 0, _FORMS)}, '{{n}}', p_name) AS name, 'canonical' AS kind
        FROM sh WHERE p_type <> 'PROMO' AND p_partkey % 10 <> 0 AND {_case("v", 8, _FORMS)} = 'canonical'""",
    "operational_clusters": f"WITH {_CLUSTERS.strip()} SELECT * FROM cl",
    "synthesised_ingredients": f"""
        WITH {_CLUSTERS.strip()} SELECT cluster_id, canonical_name, family, form, count(*) AS n_invoices, sum(n_lines)::BIGINT AS n_lines FROM cl
        WHERE NOT (family = 'batata' AND form = 'palha' AND EXISTS (SELECT 1 FROM part WHERE p_partkey % 17 = 1)) AND NOT (family = 'chicken' AND form = 'frozen' AND EXISTS (SELECT 1 FROM part WHERE p_partkey % 17 = 9)) GROUP BY 1, 2, 3, 4""",
    "unit_integrity_findings": f"WITH {_PIECES.strip()} SELECT * FROM fd WHERE patterns <> ''",
    "unit_integrity_summary": f"""
        WITH {_PIECES.strip()} SELECT pattern, (SELECT count(*) FROM fd WHERE contains(patterns, pattern)) AS n FROM (SELECT unnest([{", ".join(f"'{p}'" for p in audits.PATTERNS)}]) AS pattern)""",
    "unit_integrity_repairs": f"""
        WITH {_PIECES.strip()} SELECT ingredient_id, CASE WHEN current_price < 5 THEN 1.0 ELSE purchase_quantity END::DOUBLE AS purchase_quantity, 'un' AS cost_base_unit, embedded_g AS usable_g, embedded_ml AS usable_ml
        FROM pd WHERE current_price > 0 AND purchase_quantity > 0 AND piece AND divided AND (cost_base_unit = 'g' OR current_price < 5)""",
    "alias_integrity_audit": f"""
        WITH sh AS (SELECT *, p_partkey % {_N} AS v, (p_partkey * 7 + p_size) % {_N} AS u FROM part),
        tt AS (SELECT p_partkey, u * 100 + v AS uv, {_filled("u", 2, _OUT)} AS a, {_filled("v", 1, "p_name")} AS b FROM sh),
        ws AS (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda w: w NOT IN ('cx', '9x9'))) AS wa, list_distinct(list_filter(string_split(b, ' '), lambda w: w NOT IN ('cx', '9x9'))) AS wb FROM tt),
        cs AS (SELECT *, list_intersect(wa, {_CORE}) AS ca, list_intersect(wb, {_CORE}) AS cb FROM ws),
        tx AS (SELECT a AS t FROM tt UNION SELECT b FROM tt), pr AS (SELECT DISTINCT a, b FROM tt), {_DICE.format(pairs="pr p").strip()},
        sc AS (SELECT cs.*, dice, (len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb))))::DOUBLE AS j,
                      CASE WHEN least(len(ca), len(cb)) > 0 THEN (len(list_intersect(ca, cb)) / least(len(ca), len(cb))) ELSE 0 END::DOUBLE AS c,
                      uv IN ({", ".join(str(i * 100 + j) for i, j in _EXCLUDED)}) AS apart, uv NOT IN ({", ".join(str(i * 100 + j) for i, j in _STRANGE)}) AS akin
               FROM cs JOIN dc ON dc.a = cs.a AND dc.b = cs.b),
        lk AS (SELECT *, j * 0.35::DOUBLE + dice * 0.35::DOUBLE + c * 0.3::DOUBLE AS raw, NOT apart AND (c >= 0.34 OR j >= 0.2 OR dice >= 0.45 OR (akin AND (c > 0 OR j >= 0.12 OR dice >= 0.35))) AS likely FROM sc),
        cf AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN likely THEN greatest(0.72, least(1.0, raw + 0.15)) WHEN apart THEN least(raw, 0.12) ELSE least(raw, 0.22) END::DOUBLE AS confidence FROM lk)
        SELECT p_partkey AS alias_id, p_partkey AS ingredient_id, confidence, confidence < 0.25 AS suspicious,
               CASE WHEN a = b OR likely THEN '' WHEN apart THEN 'category_token_mismatch' WHEN c = 0 AND j < 0.15 AND dice < 0.35
                    THEN concat_ws(',', CASE WHEN j < 0.12 THEN 'low_token_jaccard' END, CASE WHEN dice < 0.3 THEN 'low_string_similarity' END) ELSE '' END AS reasons FROM cf""",
    "alias_neighbours": f"""
        WITH {_SHELF},
        al AS (SELECT DISTINCT {_filled("v", 2, _OUT)} AS a FROM sh WHERE p_partkey % 2 = 0), ct AS (SELECT {_filled("v", 1, "p_name")} AS b, min(p_partkey) AS ingredient_id FROM sh WHERE p_partkey % 2 = 1 GROUP BY 1),
        tx AS (SELECT a AS t FROM al UNION SELECT b FROM ct), pr AS (SELECT a, b FROM al CROSS JOIN ct), {_DICE.format(pairs="pr p").strip()},
        sc AS (SELECT dc.a, ingredient_id, greatest(dice, CASE WHEN length(dc.a) >= 4 AND (contains(dc.a, dc.b) OR contains(dc.b, dc.a)) THEN 0.65 ELSE 0 END)::DOUBLE AS score FROM dc JOIN ct ON ct.b = dc.b)
        SELECT a AS key, ingredient_id, score FROM sc WHERE score >= 0.58 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, ingredient_id) = 1""",
}
