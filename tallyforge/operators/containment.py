"""Names inside names: which names hold every word of another one, each anywhere in a word.

No name meets all others. A word can only stand in words of which it is a piece, so words meet pieces of words by equality; a name then meets only the names that hold its
rarest word, and is checked whole. Names and words are made distinct before they meet. Both sides of the joins grow with the names, so they are merged: files of names
are small for the rows in them, and a side taken for small would be sent through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import tokens
from tallyforge.sources.views import saved

#: Of longer words this many first letters are looked up; the rest is compared where they meet.
PIECE = 32


def _grams(word: Column, width: Column) -> Column:
    """All runs of `width` letters."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - width + 1), lambda i: F.substring(word, i, width))


def words_in_words(words: DataFrame, hosts: DataFrame) -> DataFrame:
    """word, inside: every word with the hosts that it stands in. words, hosts: a column word, distinct, not empty.

    A host is cut into pieces of those lengths only that some word has.
    """
    heads = words.select("word", F.substring("word", 1, PIECE).alias("piece"))
    lengths = F.broadcast(heads.agg(F.collect_set(F.length("piece")).alias("lengths")))
    cuts = F.transform(F.filter("lengths", lambda n: n <= F.length("word")), lambda n: _grams(F.col("word"), n))
    pieces = hosts.crossJoin(lengths).select(F.col("word").alias("inside"), F.explode(F.array_distinct(F.flatten(cuts))).alias("piece"))
    return heads.join(pieces.hint("merge"), "piece").where((F.length("word") <= PIECE) | F.contains("inside", F.col("word"))).select("word", "inside")


def contained(names: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """name, other: every pair of a name and a different host (of the names, without hosts) where each word of name stands in other.

    names, hosts: a column name; null and empty ones contain nothing and lie in nothing.
    """

    def known(rows: DataFrame) -> DataFrame:
        every = rows.select("name").where(F.length(F.trim("name")) > 0).distinct()
        return every.select("name", F.explode(tokens(F.col("name"))).alias("word"))

    wanted, held = known(names), known(names if hosts is None else hosts)
    often = held.groupBy(F.col("word").alias("inside")).agg(F.count(F.lit(1)).alias("n"))
    # read twice
    inside = saved(words_in_words(wanted.select("word").distinct(), often.select(F.col("inside").alias("word"))), "words")
    rarity = inside.join(often.hint("merge"), "inside").groupBy("word").agg(F.sum("n").alias("n_names"))
    # a word that stands nowhere rules its names out, so it must stay to be their rarest
    counted = wanted.join(rarity.hint("merge"), "word", "left").groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n_names", F.lit(0)).alias("n_names"), "word"))).alias("words"))
    rarest = lambda k: F.get("words", F.lit(k))
    leads = counted.where(rarest(0)["n_names"] > 0).select("name", rarest(0)["word"].alias("word"), F.coalesce(rarest(1)["word"], rarest(0)["word"]).alias("next"), F.transform("words", lambda w: w["word"]).alias("words"))
    met = leads.join(inside.hint("merge"), "word").join(held.select(F.col("name").alias("other"), F.col("word").alias("inside")).hint("merge"), "inside")
    # most of those that meet lack the next rarest word, which is the cheapest to look up
    whole = F.contains("other", F.col("next")) & (F.col("name") != F.col("other")) & F.forall("words", lambda w: F.contains("other", w))
    # a host with several words around the lead is met at the first of them only
    first = F.get(F.filter(tokens(F.col("other")), lambda w: F.contains(w, F.col("word"))), F.lit(0))
    return met.where(whole & (F.col("inside") == first)).select("name", "other")


def hidden_orphans(entries: DataFrame) -> DataFrame:
    """ingredient_id, name, by: entries without a use whose name lies in that of an entry in use, or equals it, with the least such entry. entries: ingredient_id, name, n_uses."""
    unused, used = entries.where(F.col("n_uses") == 0), entries.where(F.col("n_uses") > 0)
    by_name = used.groupBy(F.col("name").alias("other")).agg(F.min("ingredient_id").alias("by"))
    pairs = contained(unused, used)
    same = unused.select("name", F.col("name").alias("other")).distinct()
    host = pairs.unionByName(same).join(by_name.hint("merge"), "other").groupBy("name").agg(F.min("by").alias("by"))
    return unused.join(host.hint("merge"), "name").select("ingredient_id", "name", "by")
