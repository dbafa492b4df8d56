"""Invoice lines to catalog entries: exact keys, bounded edit distance, blocked similarity, and the cascade over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.contracts import form
from tallyforge.functions.text import bound, dice, fingerprint, tokens
from tallyforge.sources.views import saved


#: Fingerprints shorter than this say too little to be compared by edits.
LEAST_FINGERPRINT = 4
#: A fingerprint leaves about as many texts without two letters as take the time of so many comparisons, and they take disk, which comparisons don't.
DIRECT = 1_024
# Least scores of the two kinds of similarity match.
SEMANTIC, OPERATIONAL = 0.72, 0.58


def deletions(x: Column) -> Column:
    """The text and what is left of it without any one or two of its letters: texts within two edits share one of these."""

    def without(i: Column, j: Column) -> Column:
        return F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.greatest(j - i - 1, F.lit(0))), F.substring(x, j + 1, F.length(x)))

    ends = lambda i: F.transform(F.sequence(i, F.length(x)), lambda j: without(i, j))
    left = F.when(F.length(x) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.length(x)), ends)))
    return F.array_distinct(F.concat(F.array(x), F.coalesce(left, F.array().cast("array<string>"))))


def fuzzy_aliases(lines: DataFrame, aliases: DataFrame, most: int = 2, direct: int = DIRECT) -> DataFrame:
    """supplier_name, key, ingredient_id, distance: aliases of the line's own supplier with the same first word, whose fingerprint lies within `most` (two at most) edits.

    Lines whose nearest aliases name different entries have none. A line is compared with all aliases of its supplier and first word while these are at most `direct`;
    where there are more, fingerprints meet by what is left of them without one or two letters. Both ways find the same pairs.
    """
    known = aliases.where(F.trim("supplier_name") != "").select("supplier_name", "ingredient_id", F.col("normalized_alias").alias("alias")).distinct()
    first = lambda c: F.substring_index(c, " ", 1)
    mine = lines.select("supplier_name", "key").distinct().withColumn("print", fingerprint(F.col("key"))).where(F.length("print") >= LEAST_FINGERPRINT)
    theirs = known.withColumn("other", fingerprint(F.col("alias"))).where(F.length("other") >= LEAST_FINGERPRINT)
    mine = mine.withColumn("head", first("key"))
    theirs = theirs.select("supplier_name", "ingredient_id", "other", first("alias").alias("head"))
    crowd = theirs.groupBy("supplier_name", "head").agg((F.count(F.lit(1)) > direct).alias("crowded"))
    mine, theirs = mine.join(crowd, ["supplier_name", "head"]), theirs.join(crowd, ["supplier_name", "head"])
    few = mine.where(~F.col("crowded")).join(theirs.where(~F.col("crowded")).drop("crowded"), ["supplier_name", "head"])
    rest = lambda rows, c: rows.where("crowded").drop("crowded").withColumn("rest", F.explode(deletions(F.col(c))))
    many = rest(mine, "print").join(rest(theirs, "other"), ["supplier_name", "head", "rest"])
    names = ["supplier_name", "key", "ingredient_id", "print", "other"]
    pairs = few.select(*names).unionByName(many.select(*names)).distinct()
    near = pairs.withColumn("distance", F.levenshtein("print", "other", most)).where(F.col("distance") >= 0).groupBy("supplier_name", "key", "ingredient_id").agg(F.min("distance").alias("distance"))
    best = near.groupBy("supplier_name", "key").agg(F.min(F.struct("distance", "ingredient_id")).alias("a"), F.max(F.struct(-F.col("distance"), F.col("ingredient_id"))).alias("z"))
    return best.where(F.col("a.ingredient_id") == F.col("z.ingredient_id")).select("supplier_name", "key", "a.ingredient_id", "a.distance")


def _weighed(texts: DataFrame, weights: DataFrame, often: int, unseen: int, share: float) -> DataFrame:
    """key, whole (the weight of its words), bag (weight and word, heaviest first), lead (the words that a text which shares `share` of the weight must have one of in common), form.

    texts: distinct ones. Words of more than `often` entries are few and looked up where the texts lie; only the others are moved to their weights.
    """
    # without null keys on either way, which have no words, the distinct texts are moved once for both
    words = texts.where(F.col("key").isNotNull()).select("key", F.explode(tokens(F.col("key"))).alias("word"))
    common = F.broadcast(weights.where(F.col("df") > often).select("word", "weight"))
    bags = words.join(common, "word", "left").groupBy("key").agg(F.collect_list(F.struct("weight", "word")).alias("bag"))
    rare = words.join(common, "word", "left_anti").join(weights.where(F.col("df") <= often).select("word", "weight"), "word").groupBy("key").agg(F.collect_list(F.struct("weight", "word")).alias("rare"))

    total = lambda bag: F.aggregate(bag, F.lit(0).cast("long"), lambda n, t: n + t["weight"])

    def led(w: Column) -> Column:
        # what is left before each word, until too little is
        rest = lambda a, t: F.struct((a["left"] - t["weight"]).alias("left"), F.when(a["left"] >= share * w["whole"], F.concat(a["lead"], F.array(t["word"]))).otherwise(a["lead"]).alias("lead"))
        heavy = F.aggregate(w["bag"], F.struct(w["whole"].alias("left"), F.array().cast("array<string>").alias("lead")), rest, lambda a: a["lead"])
        return F.struct(w["whole"].alias("whole"), w["bag"].alias("bag"), heavy.alias("lead"), form(F.col("key")).alias("form"))

    found = lambda t: F.get(F.filter("rare", lambda r: r["word"] == t["word"]), F.lit(0))["weight"]
    bag = F.sort_array(F.transform("bag", lambda t: F.struct(F.coalesce(t["weight"], found(t), F.lit(unseen)).alias("weight"), t["word"].alias("word"))), asc=False)
    weighed = bound(bound(bag, lambda b: F.struct(b.alias("bag"), total(b).alias("whole"))), led)
    # a generator works these out once a row, however many fields are used, and a filter on forms is not pushed below it, to texts that are not distinct yet
    return bags.join(rare, "key", "left").select("key", F.explode(F.array(weighed)).alias("w")).select("key", "w.whole", "w.bag", "w.lead", "w.form")


def similar_entries(lines: DataFrame, catalog: DataFrame, share: float = 0.5, common: int = 1_000) -> DataFrame:
    """key, ingredient_id, overlap, dice, score of every distinct line key and catalog entry whose words share `share` of their weight and whose forms agree.

    A word weighs floor(1000 ln(1 + entries / entries with it)). Two texts that share enough have one of their leading, rarest words in common, so only texts
    that meet there are compared, at the first such word, and only those whose weights are near enough; common words never make a block. An entry takes its words' weights along, so those of the
    line need not move. A word of more than one in `common` entries is looked up, not joined.
    """
    entries = catalog.select("key", "ingredient_id")
    n = entries.count()
    df = entries.select(F.explode(tokens(F.col("key"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weight = lambda d: F.floor(1000 * F.log(1 + n / d)).cast("long")
    # read for either side, common words and others
    weights_ = saved(df.select("word", "df", weight(F.col("df")).alias("weight")), "weights")
    unseen = math.floor(1000 * math.log(1 + n))
    # forms are read once a text, not once a pair
    mine = _weighed(lines.select("key").distinct(), weights_, n // common, unseen, share).drop("bag")
    theirs = _weighed(entries.select("key").distinct(), weights_, n // common, unseen, share).toDF("other", "their_whole", "their_bag", "their_lead", "their_form")
    met = mine.select("*", F.explode("lead").alias("word")).join(theirs.select("*", F.explode("their_lead").alias("word")), "word")
    first = F.get(F.array_intersect("lead", "their_lead"), F.lit(0))
    near = met.where((F.col("form") == F.col("their_form")) & (F.col("whole") >= share * F.col("their_whole")) & (F.col("their_whole") >= share * F.col("whole")) & (F.col("word") == first))
    shared = lambda words: F.aggregate("their_bag", F.lit(0).cast("long"), lambda s, t: s + F.when(F.array_contains(words, t["word"]), t["weight"]).otherwise(0))
    both = near.select("key", "other", "whole", "their_whole", bound(tokens(F.col("key")), shared).alias("common"))
    both = both.withColumn("every", F.col("whole") + F.col("their_whole") - F.col("common")).where(F.col("common") >= share * F.col("every"))
    scored = both.select("key", "other", (F.col("common") / F.col("every")).alias("overlap"), dice(F.col("key"), F.col("other")).alias("dice"))
    scored = scored.withColumn("score", 0.6 * F.col("overlap") + 0.4 * F.col("dice"))
    return scored.join(entries.withColumnRenamed("key", "other"), "other").select("key", "ingredient_id", "overlap", "dice", "score")


# Places of the cascade's stages and their kinds.
_OVERRIDE, _ALIAS, _GLOBAL, _FUZZY, _EXACT, _SCORED = range(6)
_KINDS = ("override", "alias", "global_alias", "fuzzy_alias", "exact")


def _first_word(key: Column) -> Column:
    return F.substring_index(key, " ", 1)


def _answers(candidates: DataFrame, *by: str) -> DataFrame:
    """The columns of `by` with known (the entry of the alias without supplier) and rest (the best of the later stages): ingredient_id, stage, score."""
    order = F.when(F.col("stage") > _GLOBAL, F.struct("stage", -F.round("score", 9), "ingredient_id"))
    return candidates.groupBy(*by).agg(F.min(F.when(F.col("stage") == _GLOBAL, F.col("ingredient_id"))).alias("known"), F.min_by(F.when(F.col("stage") > _GLOBAL, F.struct("ingredient_id", "stage", "score")), order).alias("rest"))


def _told_of(key: Column, told: Column) -> Column:
    """ingredient_id and stage of the first stage of a supplier's own that answers, from what is told of the supplier and the key's first word."""
    of = lambda rows, what: F.filter(rows, lambda t: t["what"] == what)
    ids = lambda rows: F.transform(rows, lambda t: t["ingredient_id"])
    answer = lambda i, stage: F.when(i.isNotNull(), F.struct(i.alias("ingredient_id"), F.lit(stage).alias("stage")))

    def near(print_: Column) -> Column:
        apart = F.transform(of(told, "alias"), lambda t: F.struct(F.levenshtein(print_, t["print"], 2).alias("distance"), t["ingredient_id"].alias("ingredient_id")))
        return F.when(F.length(print_) >= LEAST_FINGERPRINT, F.filter(apart, lambda t: t["distance"] >= 0))

    def only(rows: Column) -> Column:
        nearest = bound(rows, lambda x: F.struct(F.array_min(x).alias("a"), F.array_max(F.transform(x, lambda t: F.struct((-t["distance"]).alias("d"), t["ingredient_id"].alias("i")))).alias("z")))
        return bound(nearest, lambda n: F.when(n["a"]["ingredient_id"] == n["z"]["i"], n["a"]["ingredient_id"]))

    def chosen(here: Column) -> Column:
        kept = lambda i: F.when(~F.coalesce(F.array_contains(ids(of(here, "refused")), i), F.lit(False)), i)
        one = lambda x: F.when(F.array_min(x) == F.array_max(x), F.array_min(x))
        named = F.array_min(F.filter(ids(of(here, "override")), lambda i: ~F.array_contains(ids(of(here, "refused")), i)))
        alias = bound(ids(of(here, "alias")), one)
        close = bound(fingerprint(key), lambda p: only(near(p)))
        return F.coalesce(answer(named, _OVERRIDE), bound(alias, lambda i: answer(kept(i), _ALIAS)), bound(close, lambda i: answer(kept(i), _FUZZY)))

    return F.when(told.isNotNull(), bound(F.filter(told, lambda t: t["text"] == key), chosen))


def cascade(lines: DataFrame, catalog: DataFrame, aliases: DataFrame, overrides: DataFrame, rejected: DataFrame, direct: int = 64) -> DataFrame:
    """line_id, ingredient_id, kind, score: the first stage that answers.

    Stages in order: a user's override, the confirmed alias of the supplier, the alias without supplier, an alias within two edits of its fingerprint, the
    entry of the same key, the best scored entry (semantic or operational). Rejected pairs never match. An alias that names several entries answers nothing.
    lines: line_id, supplier_name, key; catalog: ingredient_id, key; aliases: supplier_name, normalized_alias, ingredient_id; overrides and rejected: supplier_name, key, ingredient_id.

    Lines are read twice and move twice: to what is told of their supplier and first word, in one array of at most `direct` rows, and to the answers of their key.
    Those whose supplier and first word are told more of are joined stage by stage.
    """
    owner = F.when(F.coalesce(F.trim("supplier_name") != "", F.lit(False)), F.col("supplier_name")).otherwise("")
    known = aliases.where(F.col("normalized_alias").isNotNull()).select(owner.alias("supplier_name"), F.col("normalized_alias").alias("key"), "ingredient_id").distinct()
    bare = known.where(F.col("supplier_name") == "").groupBy("key").agg(F.min("ingredient_id").alias("ingredient_id"), F.max("ingredient_id").alias("last")).where(F.col("ingredient_id") == F.col("last"))
    near = similar_entries(lines, catalog).where(F.col("score") >= OPERATIONAL)
    ready = lambda rows, stage: rows.select("key", "ingredient_id", F.lit(stage).alias("stage"), F.lit(1.0).alias("score"))
    candidates = near.select("key", "ingredient_id", F.lit(_SCORED).alias("stage"), "score").unionByName(ready(bare, _GLOBAL)).unionByName(ready(catalog, _EXACT))
    candidates = saved(candidates, "candidates")
    # written, so that a key of very many lines is split where it meets its answer
    answers = saved(_answers(candidates, "key"), "answers")

    pair = ["supplier_name", "key"]
    refused = saved(rejected.select(*pair, "ingredient_id").distinct(), "refused")
    asked = refused.select(*pair).distinct()
    left = _answers(asked.join(candidates, "key").join(refused, [*pair, "ingredient_id"], "left_anti"), *pair)
    instead = asked.join(left, pair, "left").select(*pair, F.struct("known", "rest").alias("instead"))
    row = lambda rows, what, more: rows.select("supplier_name", _first_word(F.col("key")).alias("head"), F.lit(what).alias("what"), F.col("key").alias("text"), *more)
    spelt = F.when(F.length(fingerprint(F.col("key"))) >= LEAST_FINGERPRINT, fingerprint(F.col("key")))
    told = row(known.where(F.col("supplier_name") != ""), "alias", ["ingredient_id", spelt.alias("print")])
    for rows, what in ((overrides, "override"), (refused, "refused"), (instead, "instead")):
        told = told.unionByName(row(rows, what, [c for c in rows.columns if c in ("ingredient_id", "instead")]), allowMissingColumns=True)
    told = saved(told, "told")
    crowd = saved(told.groupBy("supplier_name", "head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > direct).drop("n"), "crowd")
    place = ["supplier_name", "head"]
    crowded = not crowd.isEmpty()
    few = told.join(crowd, place, "left_anti") if crowded else told
    few = saved(few.groupBy(*place).agg(F.collect_list(F.struct("what", "text", "print", "ingredient_id", "instead")).alias("told")), "few")

    asking = lines.select("line_id", "supplier_name", "key")
    apart = asking.withColumn("head", _first_word(F.col("key"))).join(crowd, place, "left_anti").drop("head") if crowded else asking
    met = apart.join(few.toDF("_supplier", "_head", "told"), (F.col("supplier_name") == F.col("_supplier")) & (_first_word(F.col("key")) == F.col("_head")), "left")
    again = F.get(F.filter("told", lambda t: (t["what"] == "instead") & (t["text"] == F.col("key"))), F.lit(0))["instead"]
    # as before, a line without supplier is answered by nothing
    heard = F.when(F.col("supplier_name").isNotNull(), F.col("key")).alias("key")
    blank = (F.trim("supplier_name") == "").alias("blank")
    met = met.select("line_id", heard, blank, _told_of(F.col("key"), F.col("told")).alias("own"), again.alias("instead"))
    if crowded:
        many = asking.withColumn("head", _first_word(F.col("key"))).join(crowd, place, "left_semi").drop("head")
        met = met.unionByName(_joined(many, known, overrides, refused, instead).select("line_id", heard, blank, "own", "instead"))
    found = met.join(answers, "key", "left")
    global_ = F.when(F.col("instead").isNull(), F.col("known")).otherwise(F.col("instead.known"))
    rest = F.when(F.col("instead").isNull(), F.col("rest")).otherwise(F.col("instead.rest"))
    found = found.select("line_id", "own", "blank", global_.alias("known"), rest.alias("rest"))
    own = F.col("own.stage")
    found = found.withColumn("stage", F.when(own <= _ALIAS, own).when(F.col("known").isNotNull(), _GLOBAL).when(own.isNotNull(), own).otherwise(F.col("rest.stage")))
    stage = F.col("stage")
    entry = F.when(stage == _GLOBAL, F.col("known")).when(stage < _EXACT, F.col("own.ingredient_id")).otherwise(F.col("rest.ingredient_id"))
    scored = F.when(F.col("rest.score") >= SEMANTIC, "semantic").otherwise("operational")
    kind = F.when((stage == _GLOBAL) & F.col("blank"), "alias").when(stage == _SCORED, scored).otherwise(F.get(F.array(*map(F.lit, _KINDS)), stage))
    score = F.when(stage == _SCORED, F.col("rest.score")).when(stage.isNotNull(), 1.0).otherwise(0.0)
    return found.select("line_id", entry.alias("ingredient_id"), F.coalesce(kind, F.lit("unmatched")).alias("kind"), score.alias("score"))


def _joined(lines: DataFrame, known: DataFrame, overrides: DataFrame, refused: DataFrame, instead: DataFrame) -> DataFrame:
    """The lines with own and instead, as `_told_of` finds them, where very many rows are told of one supplier and first word."""
    pair = ["supplier_name", "key"]
    asked = lines.select(*pair).distinct()
    scoped = known.where(F.col("supplier_name") != "")
    only = scoped.groupBy(*pair).agg(F.min("ingredient_id").alias("ingredient_id"), F.max("ingredient_id").alias("last")).where(F.col("ingredient_id") == F.col("last"))
    stages = [(asked.join(overrides, pair), _OVERRIDE), (asked.join(only, pair), _ALIAS), (fuzzy_aliases(asked, scoped.withColumnRenamed("key", "normalized_alias")), _FUZZY)]
    every = None
    for rows, stage in stages:
        rows = rows.select(*pair, "ingredient_id", F.lit(stage).alias("stage"))
        every = rows if every is None else every.unionByName(rows)
    every = every.join(refused, [*pair, "ingredient_id"], "left_anti")
    own = every.groupBy(*pair).agg(F.min(F.struct("stage", "ingredient_id")).alias("m")).select(*pair, F.struct("m.ingredient_id", "m.stage").alias("own"))
    return lines.join(own, pair, "left").join(instead, pair, "left")
