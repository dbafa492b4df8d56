"""What a name says of the product: shorthand written out, product family, preparation, alias cluster, weighted family, kinds of food, and whether it is supplier shorthand.

Rules over whole dictionaries: each step is a column of its own, so that the next ones read it instead of repeating it. Names that repeat are read once (`read_once`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import contracts, weights
from tallyforge.functions.text import folded

# What suppliers' short words stand for.
SHORTHAND = {
    "acem": "acem", "ang": "angus", "angus": "angus", "bac": "bacon", "bat": "batata", "bbq": "bbq", "box": "box", "brch": "brioche", "brd": "breaded", "breaded": "breaded", "bun": "bun",
    "bur": "burger", "burg": "burger", "caixa": "caixa", "chk": "chicken", "ched": "cheddar", "cong": "cong", "cx": "cx", "disp": "dispenser", "dn": "top down", "emb": "emb", "fat": "fatiado",
    "fin": "fino", "flt": "fatiado", "fran": "frango", "frango": "frango", "fres": "fres", "fum": "fumado", "gr": "gr", "hmb": "hamburguer", "ketch": "ketchup", "kraft": "kraft", "maio": "maionese",
    "mol": "molho", "mozza": "mozzarella", "novilho": "novilho", "on": "onion", "oni": "onion", "oreg": "orégãos", "pack": "pack", "pal": "palha", "palha": "palha", "pickl": "pickles", "pkl": "pickles",
    "pty": "patty", "ring": "rings", "rng": "rings", "ses": "sesamo", "slc": "fatiados", "slcd": "fatiados", "smk": "smoked", "smash": "smash", "shoe": "shoestring", "shoestr": "shoestring",
    "shoestrings": "shoestring", "shoestring": "shoestring", "strk": "streaky", "top": "top", "vazia": "vazia", "wdg": "wedges",
}
# The family that a word of a name tells, the least specific words among them last in effect because the first word of the name counts.
FAMILY_WORDS = {
    "batata": "batata potato", "bacon": "bacon streaky", "pickles": "pickles pepino", "chicken": "chicken frango", "bread": "brioche bun pao sesamo rustico",
    "meat": "burger hamburguer hamburger patty angus beef bovino vaca breaded novilho vazia acem", "cheddar": "cheddar", "cheese": "mozzarella queijo", "tomate": "tomate tom", "ketchup": "ketchup",
    "maionese": "maionese", "oleo": "oleo", "girassol": "girassol", "alface": "alface iceberg", "sauce": "molho mostarda bbq", "beverage": "vinho cerveja agua",
}
# Potato cuts that tell a potato where the name has no such word; words of trade that say nothing of a product.
CUTS = "palha frita fritas wedges wedge hashbrown hashbrowns sticks"
TRADE = (
    "premium service snack food auchan continente lidl eroski rama calve guloso heinz vaqueiro fula oliveira serra pingo doce top down mix gourmet especial classico tradicional extra super catering"
    " horeca restauracao profissional professional"
)
# Phrases that suppliers use for one product: cluster, family, form, phrases.
CLUSTERS = (
    ("batata-palha", "batata", "palha", ("palha snack", "batata palha", "potato sticks", "batata sticks", "palha food service")),
    ("tomate-cherry", "tomate", "cherry", ("tomate cherry", "tom cherry", "tomate cereja")),
    ("cheddar-sliced", "cheddar", "sliced", ("queijo cheddar fatiado", "queijo cheddar fatiada", "cheddar fatiado", "cheddar fatiada", "cheddar sliced")),
    ("cheddar-block", "cheddar", "block", ("queijo cheddar bloco", "cheddar bloco", "cheddar block")),
    ("cheddar-molho", "cheddar", "molho", ("queijo cheddar molho", "cheddar molho", "cheddar sauce")),
    ("cheddar-grated", "cheddar", "grated", ("queijo cheddar ralado", "queijo cheddar ralada", "cheddar ralado", "cheddar grated")),
    ("cheddar-dip", "cheddar", "dip", ("cheddar dip", "queijo cheddar dip")),
)
PLAIN_CHEDDAR = "cheddar-plain"
CHEDDAR_FORMS = "fatiado fatiada fatias sliced slice slices bloco block molho molhos ralado ralada grated dip dips"
# How strongly a word tells one of six families of a kitchen; at most 1 in sum.
FAMILY_WEIGHTS = {
    "burger_meat": {
        "smash": 0.55, "pty": 0.45, "patty": 0.45, "ang": 0.35, "angus": 0.35, "burg": 0.3, "burger": 0.3, "hamburger": 0.3, "hamburguer": 0.35, "beef": 0.3, "bovino": 0.35, "hmb": 0.4, "vaca": 0.3,
        "acem": 0.35, "vazia": 0.35, "novilho": 0.35,
    },
    "bread": {"bun": 0.6, "brioche": 0.7, "brch": 0.65, "ses": 0.4, "sesamo": 0.4, "sesame": 0.4, "pao": 0.55},
    "frozen_potato": {
        "shoe": 0.45, "shoestr": 0.45, "shoestring": 0.45, "wdg": 0.45, "wedges": 0.45, "wedge": 0.45, "pal": 0.4, "palha": 0.4, "9x9": 0.5, "batata": 0.25, "bat": 0.25, "frita": 0.2, "fritas": 0.2,
    },
    "bacon": {
        "bac": 0.35, "bacon": 0.35, "fum": 0.25, "fumado": 0.25, "smoked": 0.25, "smk": 0.25, "strk": 0.4, "streaky": 0.4, "fat": 0.2, "fatiado": 0.2, "fatiada": 0.2, "strips": 0.35, "strip": 0.35,
    },
    "chicken": {"chk": 0.35, "chicken": 0.35, "frango": 0.35, "breaded": 0.45, "flt": 0.3, "fillet": 0.3},
    "sauce": {
        "molho": 0.4, "mol": 0.35, "sauce": 0.4, "salsa": 0.35, "ketchup": 0.45, "ketch": 0.4, "catchup": 0.4, "maionese": 0.4, "maio": 0.35, "mayo": 0.35, "bbq": 0.35, "cheddar": 0.35, "ched": 0.3,
        "top": 0.35, "down": 0.2, "disp": 0.4, "dispenser": 0.45,
    },
}
DISPENSED = "top down disp dispenser molho mol"
# Words of nine kinds of food, and the kinds that one product cannot be at once.
FOOD_WORDS = {
    "potato": "batata bat potato palha pal shoestr shoestring wdg wedges fries frita fritas 9x9", "lettuce_greens": "alface lettuce iceberg rucula rucola mix salada greens folha folhas",
    "meat": "hamburguer hamburger burger burg patty pty angus beef bovino vaca chicken chk frango bacon bac carne meat fumado fum fatiado fatiada streaky strk",
    "beverage": "coca cola pepsi fanta sprite agua water sumo juice cerveja beer refrigerante bebida zero", "bread": "pao bread bun brioche sesamo sesame", "cheese": "cheddar mozzarella queijo cheese",
    "dairy": "leite milk nata cream manteiga butter", "sauce": "molho mol ketchup maio maionese mayo bbq pickles pickl", "oil": "oleo oil girassol sunflower",
}
APART = {
    "potato": "lettuce_greens meat beverage oil", "lettuce_greens": "meat beverage oil bread", "meat": "beverage oil", "bread": "beverage oil", "cheese": "beverage", "dairy": "beverage", "sauce": "beverage",
    "oil": "beverage",
}
MEASURES = "kg|kgs|g|gr|grs|mg|ml|cl|l|lt|lts|ltr|ltrs|un|uni|unid"


def _list(words: str) -> Column:
    return F.array(*[F.lit(w) for w in words.split()])


def _map(known: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])


def _told(line: Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases stands in the padded line, whole."""
    return F.array_max(F.array(*[F.contains(line, F.lit(f" {p} ")) for p in phrases]))


def product_words(name: Column) -> Column:
    """The name's words, folded, without measures and bare numbers; a cut of nine by nine is one word. Null and empty names have none."""
    x = F.regexp_replace(folded(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")
    x = F.regexp_replace(x, r"\b9 ?x ?9\b", "9x9")
    x = F.regexp_replace(x, rf"\b[0-9]+ ?(?:{MEASURES})\b", " ")
    return F.filter(F.split(F.trim(x), " +"), lambda w: (w != "") & ~F.rlike(w, F.lit("^[0-9]+$")))


def written_out(words: Column) -> Column:
    """Words with short ones written out: known ones as the table says, others of four letters and more as a known one at one edit, the shortest and then the first of them."""
    known = F.array(*[F.lit(k) for k in SHORTHAND])
    rank = F.array(*[F.struct(F.lit(len(k)).alias("length"), F.lit(at).alias("at"), F.lit(k).alias("short")) for at, k in enumerate(SHORTHAND)])
    table = _map(SHORTHAND)

    def one(w: Column) -> Column:
        close = F.array_min(F.filter(rank, lambda k: F.levenshtein(w, k["short"]) <= 1))["short"]
        guess = F.when((F.length(w) >= 4) & F.rlike(w, F.lit("[a-z]")), F.element_at(table, close))
        return F.when(F.array_contains(known, w), F.element_at(table, w)).otherwise(F.coalesce(guess, w))

    return F.filter(F.split(F.array_join(F.transform(words, one), " "), " "), lambda w: w != "")


def _cluster(words: Column, line: Column) -> Column:
    """The cluster of suppliers' phrases that the words belong to, null without one; those that name a preparation come before plain cheddar."""
    found = F.coalesce(*[F.when(_told(line, phrases), name) for name, _, _, phrases in sorted(CLUSTERS, key=lambda c: -max(map(len, c[3])))])
    plain = F.array_contains(words, F.lit("cheddar")) & ~F.arrays_overlap(words, _list(CHEDDAR_FORMS))
    return F.coalesce(found, F.when(plain, PLAIN_CHEDDAR), F.when(F.array_contains(words, F.lit("palha")), "batata-palha"))


def _identities(names: DataFrame) -> DataFrame:
    of_word = {w: family for family, known in FAMILY_WORDS.items() for w in known.split()}
    rows = names.withColumn("_said", F.transform(F.filter("words", lambda w: F.length(w) > 1), lambda w: F.when(w == "tom", "tomate").otherwise(w)))
    rows = rows.withColumns({"_own": F.array_except("_said", _list(TRADE)), "_line": F.concat(F.lit(" "), F.array_join("_said", " "), F.lit(" "))})
    potato = F.array_contains("_own", F.lit("batata"))
    rows = rows.withColumns({"cluster": _cluster(F.col("_said"), F.col("_line")), "_forms": contracts.forms_found(F.col("_line")), "_families": F.array_compact(F.transform("_own", lambda w: F.element_at(_map(of_word), w)))})
    # Fries are a preparation of potatoes only.
    rows = rows.withColumn("_forms", F.when(potato, F.col("_forms")).otherwise(F.array_remove("_forms", F.lit("frita"))))
    family = F.coalesce(F.element_at(_map({c[0]: c[1] for c in CLUSTERS} | {PLAIN_CHEDDAR: "cheddar"}), F.col("cluster")), F.get("_families", F.lit(0)), F.when(F.arrays_overlap("_own", _list(CUTS)), "batata"))
    form = F.coalesce(F.element_at(_map({c[0]: c[2] for c in CLUSTERS}), F.col("cluster")), F.nullif(contracts.ruling_form(F.col("_forms")), F.lit("none")))
    rows = rows.withColumns({"family": family, "form": form, "_rest": F.array_except("_own", _list(" ".join(FAMILY_WORDS.values())))})
    core = F.when(F.col("family").isNotNull(), F.concat_ws(" ", "family", "form")).when(F.size("_rest") > 0, F.array_join("_rest", " ")).otherwise(F.array_join("_own", " "))
    return rows.withColumn("core", core)


def _kitchens(names: DataFrame) -> DataFrame:
    words = F.col("expanded")
    grams = F.when(F.arrays_overlap(words, _list("patty pty")), weights.line_grams(F.col("name")))
    totals = {}
    for family, known in FAMILY_WEIGHTS.items():
        # Weights are whole hundredths, so that the order of the words leaves no trace in the sum.
        table = _map({w: round(100 * x) for w, x in known.items()})
        totals[f"_{family}"] = F.aggregate(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), F.lit(0))), F.lit(0), lambda n, x: n + x)  # noqa: B023
    rows = names.withColumns(totals | {"_grams": grams})
    rows = rows.withColumn("_burger_meat", F.col("_burger_meat") + F.when(F.col("_burger_meat") == 0, 0).when(F.col("_grams") == 180, 15).when(F.col("_grams") == 90, 8).otherwise(0))
    rows = rows.withColumn("_bacon", F.when(F.arrays_overlap(words, _list("bac bacon")), F.col("_bacon")).otherwise(0))
    scores = [F.struct(F.least(F.col(f"_{family}"), F.lit(100)).alias("score"), F.lit(-at).alias("at"), F.lit(family).alias("family")) for at, family in enumerate(FAMILY_WEIGHTS)]
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    cut = F.arrays_overlap(words, _list("9x9 shoe shoestr shoestring wdg wedge wedges pal palha fries frita fritas hashbrown hashbrowns"))
    baked = F.array_contains(words, F.lit("pao")) | _told(line, ("potato bread", "batata bread")) | (F.arrays_overlap(words, _list("bun brioche brch ses sesamo sesame")) & ~cut)
    sauce = F.arrays_overlap(words, _list("cheddar ched")) & F.arrays_overlap(words, _list(DISPENSED))
    rows = rows.withColumns({"_best": F.array_max(F.array(*scores)), "_baked": baked, "_sauce": sauce})
    found = F.col("_best.score") > 0
    return rows.withColumns({
        "kitchen": F.when(F.col("_baked"), "bread").when(F.col("_sauce"), "sauce").when(found, F.col("_best.family")),
        "kitchen_score": F.when(F.col("_baked"), 0.75).when(F.col("_sauce"), 0.78).when(found, F.col("_best.score") / 100),
    })


def _shorthands(names: DataFrame) -> DataFrame:
    bare = lambda w: F.length(F.regexp_replace(w, r"[^A-Za-zÀ-ÿ]", ""))
    plain = lambda w: F.length(F.regexp_replace(w, "[^A-Za-z0-9]", ""))
    x = F.trim("name")
    rows = names.withColumns({"_letters": bare(x), "_capitals": F.length(F.regexp_replace(x, "[^A-Z]", "")), "_split": F.filter(F.split(x, r"\s+"), lambda w: w != "")})
    rows = rows.withColumn("_spoken", F.filter("_split", lambda w: (bare(w) >= 2) & ~F.rlike(w, F.lit("[0-9]"))))
    rows = rows.withColumn("_lengths", F.transform("_spoken", plain))
    rows = rows.withColumns({"_n": F.size("_spoken"), "_short": F.size(F.filter("_lengths", lambda n: (n > 0) & (n <= 4))), "_longest": F.coalesce(F.array_max("_lengths"), F.lit(0))})
    n, short = F.col("_n"), F.col("_short")
    shaped = (
        ((short >= 2) & (2 * short > n)) | ((n >= 2) & (short >= 1) & (F.col("_longest") > 0) & (F.col("_longest") <= 5)) | ((n == 1) & (short == 1) & F.exists("_split", lambda w: F.rlike(w, F.lit("[0-9]"))))
        | ((100 * F.col("_capitals") >= 90 * F.col("_letters")) & (short >= 1) & (F.col("words") != F.col("expanded")))
    )
    allowed = (F.length(x) >= 3) & (F.col("_letters") >= 2) & (100 * F.col("_capitals") >= 82 * F.col("_letters")) & (F.size("_split") <= 8)
    return rows.withColumn("shorthand", allowed & ~F.exists("_split", lambda w: F.length(w) > 14) & ~F.exists("_spoken", lambda w: bare(w) >= 8) & shaped)


TOLD = ("words", "expanded", "family", "form", "cluster", "core", "kitchen", "kitchen_score", "shorthand")


def described(names: DataFrame, wanted: tuple[str, ...] = TOLD) -> DataFrame:
    """name and the wanted ones of words, expanded, family, form, cluster, core, kitchen, kitchen_score, shorthand of a column name, which must not be null. Others cost nothing.

    family, form, cluster, core: what the name is about, its preparation, the suppliers' phrase that it belongs to and the words that are left of it; unknown ones are null.
    kitchen: the strongest of six families by the weights of the words written out, of equal ones the first of the table; a bread of potato is bread, cheddar to be dispensed is
    sauce, slices alone are no bacon, and a patty of 180 or 90 grams is the surer a burger.
    shorthand: whether the name looks like a supplier's capitals and cut words: 82 of 100 letters capital, eight words at most, none long, most of them of four letters at most.
    """
    rows = names.select("name").withColumn("words", product_words(F.col("name")))
    rows = _shorthands(_kitchens(_identities(rows.withColumn("expanded", written_out(F.col("words"))))))
    # The explosion keeps filters on what is told from being pushed below the steps, where each would repeat all steps before it.
    return rows.select("name", F.explode(F.array(F.struct(*wanted))).alias("told")).select("name", "told.*")


def reading_tasks(spark: SparkSession) -> int:
    """In how many tasks texts are read: as many as the session shuffles into or has cores for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_once(rows: DataFrame, name: str, **wanted: str) -> DataFrame:
    """The rows with what `described` tells of a name, by new column names; each distinct name is read once. Null and empty names are kept, with nulls."""
    # few bytes, but long to read: a fixed number of partitions is not merged into one; by the name it would be taken for the exchange of the distinct and left out
    distinct = rows.select(F.col(name).alias("name")).where(F.trim("name") != "").distinct().repartition(reading_tasks(rows.sparkSession))
    known = described(distinct, tuple(dict.fromkeys(wanted.values())))
    return rows.join(known.select(F.col("name").alias("_name"), *[F.col(c).alias(k) for k, c in wanted.items()]), F.col(name) == F.col("_name"), "left").drop("_name")


def food_kinds(words: Column) -> Column:
    """The kinds of food that the words tell of, in the order of the table."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, _list(known)), F.lit(kind)) for kind, known in FOOD_WORDS.items()]))


def kinds_apart(a: Column, b: Column) -> Column:
    """Whether two products' kinds cannot be one product's: a forbidden pair between them, or one kind each and not the same. Products without a known kind go with all."""
    found = F.lit(False)
    for kind, others in APART.items():
        found = found | (F.array_contains(a, F.lit(kind)) & F.arrays_overlap(b, _list(others))) | (F.array_contains(b, F.lit(kind)) & F.arrays_overlap(a, _list(others)))
    single = (F.size(a) == 1) & (F.size(b) == 1) & (F.get(a, F.lit(0)) != F.get(b, F.lit(0)))
    return (F.size(a) > 0) & (F.size(b) > 0) & (found | single)


def kind(given: Column, shorthand: Column) -> Column:
    """`canonical` or `alias`: as given, where one of the two is, else by whether the name is shorthand."""
    told = F.lower(F.trim(given))
    return F.when(told.isin("canonical", "alias"), told).when(shorthand, "alias").otherwise("canonical")
