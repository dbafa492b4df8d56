"""Audits of a catalog: units that contradict names, aliases that contradict their entries, and the entry that an alias is nearest to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import identity
from tallyforge.functions.text import bigrams, folded
from tallyforge.sources.views import saved

# Words of goods that are bought by the piece, of goods that are weighed, and units of mass.
BY_PIECE = "bun buns brioche pao bread baguette croissant wrap lata latas garrafa garrafas pack packs caixa cx un uni unid"
WEIGHED = "kg kilo novilho vitelao vitela frango porco carne beef meat farinha flour azeite oil manteiga butter"
MASS_UNITS = ("g", "gr", "gram", "grams", "ml", "cl")
PATTERNS = ("embedded_weight_with_mass_base", "gram_denominator_matches_embedded_weight", "mass_base_on_countable_name", "inferred_mass_base_from_pq_heuristic", "countable_name_weight_family_mismatch")
#: Below this price a pack is one piece.
PIECE_PRICE = 5.0
# Words of packing, which say nothing of the product; below this an alias is suspicious; least similarity of a neighbour; similarity of a name inside a name.
PACKING = "kg kgs g gr grs mg ml cl l lt lts ltr ltrs un uni unid unids und unds pc pcs lata pet garrafa bottle pack caixa cx emb disp"
VERY_LOW = 0.25
LEAST_NEIGHBOUR = 0.58
CONTAINED = 0.65


def _measured(frame: DataFrame) -> DataFrame:
    """The frame with embedded_g, embedded_ml, by_piece, mass and inferred."""
    x = folded(F.coalesce("name", F.lit("")))
    words = F.split(x, "[^a-z0-9_]+")
    size = F.regexp_extract(x, r"([0-9]+(?:[.,][0-9]+)?)\s*(?:grams?|grs?|g|ml|cl)\b", 1)
    unit = F.regexp_extract(x, r"[0-9]\s*(grams?|grs?|g|ml|cl)\b", 1)
    named = lambda known: F.arrays_overlap(words, F.array(*[F.lit(w) for w in known.split()]))
    # The explosion keeps filters from being pushed below the reading of the name, which they would repeat.
    read = F.struct(F.nullif(F.translate(F.nullif(size, F.lit("")), ",", ".").cast("double"), F.lit(0.0)).alias("amount"), unit.alias("unit"), named(BY_PIECE).alias("piece"), named(WEIGHED).alias("weighed"))
    frame = frame.select("*", F.explode(F.array(read)).alias("_read"))
    amount, unit = F.col("_read.amount"), F.col("_read.unit")
    return frame.withColumns({
        "embedded_g": F.when(~unit.isin("ml", "cl"), amount), "embedded_ml": F.when(unit == "ml", amount).when(unit == "cl", amount * 10),
        "mass": F.lower(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("base_unit", "purchase_unit", "unit")])).isin(*MASS_UNITS),
        "inferred": F.when(F.col("purchase_quantity") == 1000, "g").when(F.col("purchase_quantity") > 1000, "ml").otherwise("un"),
        "by_piece": F.col("_read.piece") | (amount.isNotNull() & ~F.col("_read.weighed")),
    })


def _divided() -> Column:
    """Whether the quantity is the size in the name."""
    return F.coalesce(F.abs(F.col("purchase_quantity") - F.coalesce("embedded_g", "embedded_ml")) < 0.01, F.lit(False))


def unit_findings(entries: DataFrame) -> DataFrame:
    """ingredient_id, name, patterns, embedded_g, embedded_ml, purchase_quantity, inferred: entries whose unit or quantity contradicts the name, with the patterns of it in the table's order.

    entries: ingredient_id, name, purchase_quantity, purchase_unit, base_unit, unit. Entries without an id or name are left out. One pass, no shuffle.
    """
    rows = _measured(entries.where(F.col("ingredient_id").isNotNull() & (F.trim("name") != "")))
    sized, piece, mass = F.col("embedded_g").isNotNull() | F.col("embedded_ml").isNotNull(), F.col("by_piece"), F.coalesce("mass", F.lit(False))
    tests = (sized & mass, piece & _divided(), piece & mass, piece & (F.col("inferred") == "g"), piece & sized & (F.col("inferred") == "g"))
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in zip(PATTERNS, tests, strict=True)]))
    told = rows.withColumn("patterns", F.array_join(found, ",")).where("patterns != ''")
    return told.select("ingredient_id", "name", "patterns", "embedded_g", "embedded_ml", "purchase_quantity", "inferred")


def unit_summary(findings: DataFrame) -> DataFrame:
    """pattern, n: how many entries show each pattern; patterns that none shows count 0."""
    counts = findings.select(*[F.coalesce(F.sum(F.array_contains(F.split("patterns", ","), p).cast("long")), F.lit(0)).alias(p) for p in PATTERNS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(p).alias("n")) for p in PATTERNS])).alias("x")).select("x.*")


def repaired_units(entries: DataFrame) -> DataFrame:
    """ingredient_id, purchase_quantity, cost_base_unit, usable_g, usable_ml: entries by the piece whose price was divided by the size in the name, put right.

    They count in pieces again, a single piece where the price is that of one. Entries without a price or quantity above 0 are not told and left out.
    """
    rows = _measured(entries.where((F.col("current_price") > 0) & (F.col("purchase_quantity") > 0) & (F.trim("name") != "")))
    single = F.col("current_price") < PIECE_PRICE
    wrong = rows.where(F.col("by_piece") & _divided() & (F.coalesce(F.col("cost_base_unit").isin("g", "ml"), F.lit(False)) | single))
    return wrong.select(
        "ingredient_id", F.when(single, 1.0).otherwise(F.col("purchase_quantity")).alias("purchase_quantity"), F.lit("un").alias("cost_base_unit"),
        F.col("embedded_g").alias("usable_g"), F.col("embedded_ml").alias("usable_ml"),
    )


def _share(a: Column, b: Column, of: Column) -> Column:
    return F.when(of > 0, F.size(F.array_intersect(a, b)) / of).otherwise(0.0)


def _pairs_numbered(x: Column) -> Column:
    """Letter pairs with the number of equal ones before, so that counting equal members counts repeats; a single letter is its own."""
    pairs = bigrams(x)
    numbered = F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, 1, i), lambda q: q == p)).cast("string")))
    return F.when(F.length(x) == 1, F.array(x)).otherwise(numbered)


def _likeness(a: Column, b: Column) -> Column:
    """Twice the common numbered pairs over all of them, 0 where one has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def alias_findings(aliases: DataFrame) -> DataFrame:
    """alias_id, ingredient_id, confidence, reasons, suspicious: how plausible it is that an alias means its entry. aliases: alias_id, alias_name, ingredient_id, name.

    Equal names are sure. Names that share words, letter pairs or words of food are likely unless their kinds of food exclude each other; others are doubted, with the reasons.
    Aliases without a text are left out; an entry without a name is called by its id. Each distinct name is read once, each distinct pair of names compared once.
    """
    named = aliases.where(F.trim("alias_name") != "").withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("ingredient_id").cast("string")))
    rows = saved(named.select("alias_name", "name").distinct(), "pairs")
    core = F.array(*[F.lit(w) for known in identity.FOOD_WORDS.values() for w in known.split()])
    packing = F.array(*[F.lit(w) for w in PACKING.split()])
    bag = lambda words: F.filter(F.array_distinct(F.array_except(words, packing)), lambda w: (F.length(w) >= 2) & ~F.rlike(w, F.lit("^[0-9]+x[0-9]+$")))
    rows = identity.read_once(identity.read_once(rows, "alias_name", _a="expanded"), "name", _c="words")
    # few bytes, but long to compare: a fixed number of partitions is not merged into one
    rows = rows.repartition(identity.reading_tasks(rows.sparkSession))
    rows = rows.withColumns({"_ta": bag(F.col("_a")), "_tc": bag(F.col("_c")), "_sa": F.array_join("_a", " "), "_sc": F.array_join("_c", " ")})
    rows = rows.withColumns({"_ga": _pairs_numbered(F.col("_sa")), "_gc": _pairs_numbered(F.col("_sc"))})
    rows = rows.withColumns({
        "_ka": identity.food_kinds(F.col("_ta")), "_kc": identity.food_kinds(F.col("_tc")), "_fa": F.array_intersect("_ta", core), "_fc": F.array_intersect("_tc", core),
        "jaccard": F.when((F.size("_ta") == 0) & (F.size("_tc") == 0), 1.0).otherwise(_share(F.col("_ta"), F.col("_tc"), F.size(F.array_union("_ta", "_tc")))),
        "likeness": _likeness(F.col("_ga"), F.col("_gc")),
    })
    rows = rows.withColumns({"core": _share(F.col("_fa"), F.col("_fc"), F.least(F.size("_fa"), F.size("_fc"))), "apart": identity.kinds_apart(F.col("_ka"), F.col("_kc"))})
    jaccard, likeness, shared = F.col("jaccard"), F.col("likeness"), F.col("core")
    akin = (F.size("_ka") == 0) | (F.size("_kc") == 0) | F.arrays_overlap("_ka", "_kc")
    likely = ~F.col("apart") & ((shared >= 0.34) | (jaccard >= 0.2) | (likeness >= 0.45) | (akin & ((shared > 0) | (jaccard >= 0.12) | (likeness >= 0.35))))
    raw = jaccard * 0.35 + likeness * 0.35 + shared * 0.3
    same = (F.col("_sa") == F.col("_sc")) & (F.col("_sa") != "")
    confidence = F.when(same, 1.0).when(likely, F.greatest(F.lit(0.72), F.least(F.lit(1.0), raw + 0.15))).otherwise(F.least(raw, F.when(F.col("apart"), 0.12).otherwise(0.22)))
    doubts = F.when(F.col("apart"), F.array(F.lit("category_token_mismatch"))).when(
        (shared == 0) & (jaccard < 0.15) & (likeness < 0.35),
        F.array_compact(F.array(F.when(jaccard < 0.12, F.lit("low_token_jaccard")), F.when(likeness < 0.3, F.lit("low_string_similarity")))),
    )
    reasons = F.when(same | likely, "").otherwise(F.coalesce(F.array_join(doubts, ","), F.lit("")))
    told = saved(rows.select(F.col("alias_name").alias("_alias"), F.col("name").alias("_name"), confidence.alias("confidence"), reasons.alias("reasons"), (confidence < VERY_LOW).alias("suspicious")), "told")
    met = named.join(told.hint("merge"), (F.col("alias_name") == F.col("_alias")) & F.col("name").eqNullSafe(F.col("_name")))
    return met.select("alias_id", "ingredient_id", "confidence", "reasons", "suspicious")


def neighbours(aliases: DataFrame, catalog: DataFrame, least: float = LEAST_NEIGHBOUR) -> DataFrame:
    """key, ingredient_id, score: the entry nearest to each distinct alias, of equal ones the least id. aliases: key; catalog: ingredient_id, key. Null and empty keys have no neighbour.

    The score is twice the common letter pairs over all of them, at least 0.65 where one name lies in the other and the alias has four letters. Names that can reach `least`
    share one of their rarest pairs, as many as would leave too few in common, so only these meet; a name lies only in names with its rarest pair. No pair of names
    of two letters and more is lost; a name of one letter is compared with its equals only.
    """
    mine = aliases.select("key").where(F.trim("key") != "").distinct()
    entries = catalog.where(F.trim("key") != "").groupBy("key").agg(F.min("ingredient_id").alias("ingredient_id"))
    sides = mine.select("key", F.lit(None).cast("long").alias("ingredient_id"), F.lit(True).alias("is_alias")).unionByName(entries.select("key", F.col("ingredient_id").cast("long"), F.lit(False).alias("is_alias")))
    spread = sides.select("*", F.explode(_pairs_numbered(F.col("key"))).alias("gram"))
    often = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # All joins below read the pairs of every name in order of rarity, so they are written once.
    ordered = saved(spread.join(often, "gram").groupBy("is_alias", "ingredient_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda g: g["gram"]).alias("grams")), "neighbours")
    needed = F.ceil(F.size("grams") * (least / (2 - least)) - 1e-9)
    every = F.col("grams")
    leads = F.slice("grams", F.lit(1), F.greatest(F.size("grams") - needed + 1, F.lit(1)).cast("int"))
    rarest = F.slice("grams", 1, 1)
    names = lambda grams: ordered.where("is_alias").select("key", F.explode(grams).alias("gram"))
    others = lambda grams: ordered.where("NOT is_alias").select(F.col("key").alias("other"), "ingredient_id", F.explode(grams).alias("gram"))
    a, b = F.length("key"), F.length("other")
    inside, around = (a >= 4) & F.contains("other", F.col("key")), (a >= 4) & F.contains("key", F.col("other"))
    alike = names(leads).join(others(leads), "gram").where(2 * F.least(a - 1, b - 1) >= least * (a + b - 2) - 1e-9)
    met = alike.unionByName(names(rarest).join(others(every), "gram").where(inside)).unionByName(names(every).join(others(rarest), "gram").where(around))
    met = met.select("key", "other", "ingredient_id").distinct()
    met = met.join(ordered.where("is_alias").select("key", F.col("grams").alias("_ga")), "key").join(ordered.where("NOT is_alias").select(F.col("key").alias("other"), F.col("grams").alias("_gb")), "other")
    scored = met.withColumn("score", F.greatest(_likeness(F.col("_ga"), F.col("_gb")), F.when(inside | around, CONTAINED).otherwise(0.0)))
    best = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("ingredient_id")).alias("_id"))).alias("b")).where(F.col("b.score") >= least)
    return best.select("key", (-F.col("b._id")).alias("ingredient_id"), "b.score")
