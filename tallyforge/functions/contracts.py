"""What a purchase's name and unit say of its contract: unit family, preservation, form, weight, and whether it is a plausible liquid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import packs, units, weights
from tallyforge.functions.text import bound, folded

# Words of preservation, of preparation by the form that they stand for, and of drinks; the dearest plausible litre, the smallest plausible pack.
PRESERVED = ("em conserva", "conserva", "pickled", "escabeche", "em salmoura", "frasco", "jar", "lata", "canned", "embalagem")
FRESH = ("fresco", "fresh")
FORMS = {
    "corte_fino": ("corte fino", "corte fina"), "hashbrown": ("hash brown", "hashbrown", "hashbrowns"), "palha": ("potato sticks", "batata sticks", "palha"), "frita": ("frita", "fritas"),
    "wedges": ("wedge", "wedges"), "molho": ("molho", "molhos"), "block": ("bloco", "block"), "sliced": ("fatiado", "fatiada", "fatias", "slice", "sliced", "slices"), "dip": ("dip", "dips"),
    "cherry": ("cherry", "cereja", "cerejas"), "triturado": ("triturado", "triturada", "triturados"), "frozen": ("congelado", "congelada", "frozen"), "grated": ("grated", "ralado", "ralada"),
}
#: Of several forms in one name these win, in order; else all of them make one form of their own.
RULING_FORMS = ("palha", "corte_fino", "cherry", "triturado")
DRINKS = ("beer", "cerveja", "cola", "soda", "agua", "water", "juice", "sumo", "refrigerante", "tonic", "ginger", "limonada", "lemonade", "drink", "bebida")
MOST_A_LITRE = 50.0
LEAST_PACK_ML = 50.0


def _padded(name: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded(name), "[^a-z0-9]+", " ")), F.lit(" "))


def _any(words: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(words, F.lit(f" {phrase} "))
    return found


def preservation(name: Column) -> Column:
    words = _padded(name)
    return F.when(_any(words, PRESERVED), "preserved").when(_any(words, FRESH), "fresh").otherwise("unknown")


def forms_found(words: Column) -> Column:
    """All preparations that a line of padded words tells of, by name."""
    return F.array_compact(F.array(*[F.when(_any(words, phrases), F.lit(kind)) for kind, phrases in sorted(FORMS.items())]))


def ruling_form(found: Column) -> Column:
    """One preparation for those found, `none` without one."""
    ruling = F.coalesce(*[F.when(F.array_contains(found, kind), F.lit(kind)) for kind in RULING_FORMS])
    return F.when(F.size(found) == 0, "none").when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.coalesce(ruling, F.array_join(found, "+")))


def form(name: Column) -> Column:
    """The preparation that the name tells of, `none` without one. Most names tell of none, which one pattern finds; the others' words are bound in an array, so they are found once."""
    phrases = "|".join(p for found in FORMS.values() for p in found)
    told = lambda words: F.when(F.rlike(words, F.lit(f" (?:{phrases}) ")), bound(forms_found(words), ruling_form)).otherwise("none")
    return bound(_padded(name), told)


def described(rows: DataFrame, name: str = "printed", unit: str = "unit") -> DataFrame:
    """The rows with family, preservation, form, contract, grams, pack_ml, drink. Names repeat, so each pair of name and unit is read once and joined back."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # few bytes, but long to read: a fixed number of partitions is not merged into one
    texts = rows.select(F.col(name).alias("_name"), F.coalesce(F.trim(F.lower(unit)), F.lit("")).alias("_unit")).distinct().repartition(tasks)
    read = texts.select("*", F.explode(F.array(packs.structure(F.col("_name")))).alias("s"))
    by_pack = units.unit_family(F.col("s.usable_unit"))
    read = read.withColumns({
        "family": F.coalesce(units.unit_family(F.col("_unit")), by_pack, F.lit("countable")), "preservation": preservation(F.col("_name")), "form": form(F.col("_name")),
        "grams": weights.line_grams(F.col("_name")), "pack_ml": F.when(F.col("s.usable_unit") == "ml", F.col("s.usable")), "drink": _any(_padded(F.col("_name")), DRINKS),
    })
    contract = F.concat_ws(":", "family", F.when(F.col("_unit") == "", "na").otherwise(F.col("_unit")), "form", "preservation")
    read = read.withColumn("contract", contract).drop("s")
    keyed = rows.withColumn("_unit", F.coalesce(F.trim(F.lower(unit)), F.lit("")))
    return keyed.join(read, (keyed[name] == read["_name"]) & (keyed["_unit"] == read["_unit"]), "left").drop(read["_unit"]).drop("_name", "_unit")


def implausible(price: Column, unit: Column) -> Column:
    """Whether a described liquid or drink is too dear a litre, or its pack too small, to enter a history."""
    litre = F.when(F.col("family") == "volume", F.when(F.lower(F.trim(unit)).isin("l", "lt"), price).otherwise(price * 1000))
    liquid = (F.col("family") == "volume") | F.col("drink")
    return F.coalesce(liquid & (F.coalesce(litre > MOST_A_LITRE, F.lit(False)) | F.coalesce(F.col("pack_ml") < LEAST_PACK_ML, F.lit(False))), F.lit(False))
