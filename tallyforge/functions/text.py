"""Name keys and similarity as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what they fold to; units and noise that names carry.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"
UNIT_WORDS = r"(?:kg|g|gr|mg|l|lt|cl|dl|ml|un|uni|unid|pcs|cx|sc|emb|pack)"
LEGAL_SUFFIXES = r"(?:lda|ltda|sa|s\.a|unipessoal|inc|llc|ltd|gmbh)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, and read by lambda: long chains of patterns written out in one generated method grow past what the virtual machine compiles, and run ten times slower."""
    return F.transform(F.array(value), use)[0]


def folded(x: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def simple_key(name: Column) -> Column:
    """Folded, parentheses and hyphens gone, blanks single."""
    x = F.regexp_replace(folded(name), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[-_/]+", " "), r"\s+", " "))


def canonical_key(name: Column) -> Column:
    """The simple key without packs, sizes, unit words, numbers and punctuation."""

    def cleaned(x: Column) -> Column:
        x = simple_key(x)
        x = F.regexp_replace(x, r"[0-9]+(?:[.,][0-9]+)?\s*[x*]\s*[0-9]+(?:[.,][0-9]+)?", " ")
        x = F.regexp_replace(x, rf"(?:^|(?<=\s))[0-9]+(?:[.,][0-9]+)?\s*{UNIT_WORDS}?(?=\s|$)", " ")
        x = F.regexp_replace(x, r"[^a-z0-9 ]+", " ")
        x = F.regexp_replace(x, rf"(?:^|(?<=\s)){UNIT_WORDS}(?=\s|$)", " ")
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    return bound(name, cleaned)


def supplier_key(name: Column) -> Column:
    """Folded, without file extension, legal form and punctuation."""
    x = F.regexp_replace(folded(name), r"\.(?:pdf|png|jpe?g|xlsx?)$", "")
    x = F.regexp_replace(x, rf"[,\s]+{LEGAL_SUFFIXES}\.?\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9]+", " "), r"\s+", " "))


def fingerprint(key: Column) -> Column:
    """What is left of a key without its first word, numbers, unit words and blanks: mostly the brand."""

    def cleaned(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\S+\s+", "")
        x = F.regexp_replace(x, rf"(?:^|(?<=\s))(?:[0-9.,]+|{UNIT_WORDS}|de|da|do|com|em)(?=\s|$)", " ")
        return F.regexp_replace(x, r"\s+", "")

    return bound(key, cleaned)


def bigrams(x: Column) -> Column:
    """Character pairs in order, with repeats."""
    n = F.length(x)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice the common character pairs, counted with repeats, over all pairs; 1 for equal texts, 0 where one has no pair."""

    def count(pairs: Column, g: Column) -> Column:
        return F.size(F.filter(pairs, lambda p: p == g))

    def compared(s: Column) -> Column:
        x, y = s["x"], s["y"]
        # where one side repeats no pair, a common pair counts once
        once = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
        repeated = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, g: acc + F.least(count(x, g), count(y, g)))
        common = F.when(once, F.size(F.array_intersect(x, y))).otherwise(repeated)
        return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * common / (F.size(x) + F.size(y))).otherwise(0.0)

    return F.when(a == b, 1.0).otherwise(bound(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y")), compared))


def tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, " "), lambda w: w != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Common words over the words of the shorter."""
    x, y = tokens(a), tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def weakly_contains(a: Column, b: Column) -> Column:
    """Whether the shorter, of at least five letters, stands in the longer between word ends."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.length(short) >= 5) & F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))


# Words that put an ingredient into a cost category; the first category with one of its words counts.
COST_WORDS = {
    "meat": "beef novilho porco frango carne meat bacon ham lombo vazia acem acém peru turkey veal lamb borrego",
    "dairy": "cheese queijo manteiga butter cream nata leite milk dairy iogurte yogurt",
    "produce": "tomate onion cebola alho garlic salad lettuce alface pepper piment produce vegetable fruta fruit limão lemon cenoura carrot batata potato",
    "sauces": "sauce molho ketchup maionese mayo hellmann mustard mostarda bbq relish vinagre vinegar dressing",
    "bakery": "bread pão bun brioche farinha flour bakery bolo cake pastry massa dough",
    "beverage": "cola soda beer cerveja wine vinho coffee café juice sumo water água beverage drink",
}


def cost_category(name: Column) -> Column:
    """The cost category that a whole word of the name tells, `other` without one."""
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}0-9_]+")
    out = F.lit("other")
    for category, known in reversed(COST_WORDS.items()):
        out = F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in known.split()])), category).otherwise(out)
    return out
