"""Pack structures in purchase texts: "4 cases x 24 x 330ml" is 4 cases of 24 pieces of 330 ml.

A text is read as typed tokens. A rule is a run of token kinds with the parts that it names; rules are tried in order of precedence, and of several runs that one rule
finds the one that holds most wins. All of it is array expressions on one row: no shuffle and no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import folded

# Words by kind, folded. The measures with the unit that stands for them; mg counts as g, unscaled.
CASES = ("caixa", "caixas", "cx")
CONTAINERS = {
    "bottle": ("bottle", "bottles", "garrafa", "garrafas"), "pack": ("pack", "packs", "emb", "embalagem", "embalagens"), "case": (*CASES, "case", "cases"),
    "can": ("lata", "latas", "can", "cans"), "bag": ("saco", "sacos", "bag", "bags"), "box": ("box", "boxes"),
}
COUNTS = ("un", "uni", "und", "unds", "ud", "uds", "unid", "unids", "unit", "units", "pc", "pcs")
INNER = ("un", "uni", "und", "unds", "unid", "unids", "unit", "units", *CONTAINERS["can"], *CONTAINERS["bottle"])
DOZENS = ("duzia", "duzias", "dozen", "dozens", "dz")
MEASURES = {"kg": ("kg", "kgs"), "g": ("g", "gr", "grs", "mg"), "ml": ("ml",), "cl": ("cl",), "L": ("l", "lt", "lts", "ltr", "ltrs")}
BASE = {"kg": ("g", 1000.0), "g": ("g", 1.0), "ml": ("ml", 1.0), "cl": ("ml", 10.0), "L": ("ml", 1000.0), "un": ("un", 1.0)}
GENERIC_ROW_UNITS = (*COUNTS, "unidade", "unidades", *CONTAINERS["pack"], *CONTAINERS["case"])
CASE_ROW_UNITS = (*CASES, "case", "cases", "emb", "embalagem", "embalagens")
DOZEN = 12.0


@dataclass(frozen=True)
class Rule:
    """kinds: of the tokens in a row. The other fields are places in it: how many are bought, the container's word, how many lie inside, their word, and the size, behind which its unit stands."""

    tier: str
    kinds: tuple[str, ...]
    bought: int | None = None
    container: int | None = None
    inner: int | None = None
    inner_word: int | None = None
    size: int | None = None


RULES = (
    Rule("triple_nested", ("number", "container", "times", "number", "times", "number", "measure"), bought=0, container=1, inner=3, size=5),
    Rule("caixa_units_size", ("case", "number", "inner", "times", "number", "measure"), container=0, inner=1, inner_word=2, size=4),
    Rule("caixa_compact_size", ("case", "number", "times", "number", "measure"), container=0, inner=1, size=3),
    Rule("caixa_dozen_count", ("case", "number", "dozen"), container=0, inner=1, inner_word=2),
    Rule("caixa_dozen_count", ("case", "point", "number", "dozen"), container=0, inner=2, inner_word=3),
    Rule("units_size", ("number", "count", "times", "number", "measure"), inner=0, inner_word=1, size=3),
    Rule("size_count", ("number", "measure", "times", "number", "count"), inner=3, inner_word=4, size=0),
    Rule("size_count", ("number", "measure", "times", "number"), inner=3, size=0),
    Rule("caixa_compact_size", ("case", "number"), container=0, inner=1),
    Rule("container_size", ("container", "number", "times", "number", "measure"), bought=1, container=0, size=3),
    Rule("container_size", ("number", "container", "times", "number", "measure"), bought=0, container=1, size=3),
    Rule("count_size", ("number", "times", "number", "measure"), bought=0, size=2),
    Rule("bare_measure", ("number", "measure"), size=0),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _named(word: Column, names: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in names.items():
        out = F.when(word.isin(*words), name).otherwise(out)
    return out


def _base(unit: Column, place: int) -> Column:
    out = F.lit(None)
    for name, values in BASE.items():
        out = F.when(unit == name, F.lit(values[place])).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Numbers, words and signs in order: text, value, container, measure, one flag a kind, and whether the token has a word's edge before and behind it."""
    units = "|".join(sorted({w for words in MEASURES.values() for w in words} | set(COUNTS), key=lambda w: (-len(w), w)))
    plain = F.trim(F.regexp_replace(folded(text), r"\s+", " "))
    found = F.regexp_extract_all(plain, F.lit(rf" ?(?:[0-9]+(?:[.,][0-9]+)?|(?:{units})(?=x[0-9])|x(?=[0-9])|\p{{L}}+|[^ ])"), F.lit(0))

    def typed(raw: Column) -> Column:
        word = F.trim(raw)
        return F.struct(
            word.alias("text"), F.replace(word, F.lit(","), F.lit(".")).try_cast("double").alias("value"), _named(word, CONTAINERS).alias("label"), _named(word, MEASURES).alias("unit"),
            F.startswith(raw, F.lit(" ")).alias("gap"), F.rlike(word, F.lit(r"^[\p{L}0-9_]")).alias("word"),
        )

    def flagged(all_: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before, after = F.get(all_, i - 1), F.get(all_, i + 1)
            number = t["value"].isNotNull() & F.rlike(t["text"], F.lit("^[0-9]"))
            return F.struct(
                t["text"].alias("text"), t["value"].alias("value"), t["label"].alias("label"), t["unit"].alias("unit"), t["gap"].alias("gap"),
                (number & (t["value"] > 0)).alias("number"), number.alias("digits"), t["text"].isin("x", "×", "*").alias("times"), t["label"].isNotNull().alias("container"), t["text"].isin(*CASES).alias("case"),
                t["text"].isin(*INNER).alias("inner"), t["text"].isin(*COUNTS).alias("count"), t["text"].isin(*DOZENS).alias("dozen"), t["unit"].isNotNull().alias("measure"),
                (t["text"] == ".").alias("point"), (~t["word"] | t["gap"] | ~F.coalesce(before["word"], F.lit(False))).alias("begins"),
                (~t["word"] | F.coalesce(after["gap"] | ~after["word"], F.lit(True))).alias("ends"),
            )

        return F.transform(all_, one)

    return _let(F.transform(found, typed), flagged)


def measure_tokens(text: Column) -> Column:
    """All numbers with a measure behind them: struct of value and the unit as it is written."""
    return _let(tokens(text), lambda ts: F.transform(F.filter(_places(ts, RULES[-1].kinds), lambda i: i >= 0), lambda i: F.struct(ts[i]["value"].alias("value"), ts[i + 1]["text"].alias("unit"))))


def _matches(ts: Column, i: Column, kinds: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for j, kind in enumerate(kinds):
        found = found & F.coalesce(F.get(ts, i + j)[kind], F.lit(False))
    return found & F.coalesce(F.get(ts, i)["begins"] & F.get(ts, i + len(kinds) - 1)["ends"], F.lit(False))


def _places(ts: Column, kinds: tuple[str, ...]) -> Column:
    """Where runs of these kinds begin."""
    return F.filter(F.transform(ts, lambda t, i: F.when(_matches(ts, i, kinds), i)), lambda i: i.isNotNull())


def _size(ts: Column, i: Column) -> Column:
    """The number at i with its measure behind it; 0,33 cl is a slip for 33 cl."""
    number, unit = ts[i], F.get(ts, i + 1)["unit"]
    decimals = F.regexp_extract(number["text"], "^0[.,]([0-9]+)$", 1).try_cast("double")
    return F.when((unit == "cl") & (number["value"] < 1) & (decimals >= 1), decimals).otherwise(number["value"])


def _amount(ts: Column, i: Column) -> Column:
    return _size(ts, i) * _base(F.get(ts, i + 1)["unit"], 1)


def _no_number() -> Column:
    return F.lit(None).cast("double")


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _reading(rule: Rule, ts: Column, i: Column, size_at: Column | None) -> Column:
    """score, back (ties go to the first), tier, bought, container, inner, inner_kind, size, unit of the rule's run at i."""
    bought = ts[i + rule.bought]["value"] if rule.bought is not None else F.lit(1.0)
    inner = ts[i + rule.inner]["value"] if rule.inner is not None else _no_number()
    if size_at is None:
        size, unit, held = F.lit(DOZEN), F.lit("un"), F.lit(1.0)
    else:
        size, unit, held = _size(ts, size_at), F.get(ts, size_at + 1)["unit"], _amount(ts, size_at)
    default = "case" if rule.container is not None else "unit"
    container = F.coalesce(ts[i + rule.container]["label"], F.lit(default)) if rule.bought is not None and rule.container is not None else F.lit(default)
    word = ts[i + rule.inner_word]["text"] if rule.inner_word is not None else F.lit("un")
    kind = F.when(word.isin(*CONTAINERS["can"]), "can").when(word.isin(*CONTAINERS["bottle"]), "bottle").when(word.isin(*DOZENS), "dozen").otherwise("unit")
    return F.struct(
        (bought * F.coalesce(inner, F.lit(1.0)) * held).alias("score"), (-i).alias("back"), F.lit(rule.tier).alias("tier"), bought.alias("bought"), container.alias("container"), inner.alias("inner"),
        (kind if rule.inner is not None else _no_text()).alias("inner_kind"), size.alias("size"), unit.alias("unit"),
    )


def _suspicious(ts: Column, i: Column, size_at: Column) -> Column:
    """One container of much more than a piece named before it: "80g 1 pack x 120 g" repeats the piece, and is no pack."""
    held, kind = _amount(ts, size_at), _base(ts[size_at + 1]["unit"], 0)
    pieces = F.filter(_places(ts, RULES[-1].kinds), lambda p: (p + 1 < i) & (_base(ts[p + 1]["unit"], 0) == kind))
    least = F.array_min(F.transform(pieces, lambda p: _amount(ts, p)))
    return F.coalesce((ts[i]["value"] == 1) & (held >= 100) & (held >= least * 1.25), F.lit(False))


def _best(rule: Rule, ts: Column) -> Column:
    """The reading of the rule that holds most, null without one."""

    def at(i: Column) -> Column:
        if rule.size is not None:
            read = _reading(rule, ts, i, i + rule.size)
        elif "dozen" in rule.kinds:
            read = _reading(rule, ts, i, None)
        else:  # the piece stands elsewhere in the text
            piece = _let(_places(ts, RULES[-1].kinds), lambda ps: F.array_max(F.transform(ps, lambda p: F.struct(_amount(ts, p).alias("amount"), (-p).alias("back")))))
            read = _let(piece, lambda p: F.when(p.isNotNull(), _reading(rule, ts, i, -p["back"])))
        if rule.tier == "container_size" and rule.bought == 0:
            return F.when(~_suspicious(ts, i, i + rule.size), read)
        if rule.tier == "count_size":
            return F.when(ts[i]["value"] > 1, read)
        return read

    return F.array_max(F.filter(F.transform(_places(ts, rule.kinds), at), lambda r: r.isNotNull()))


def _bare_refused(ts: Column) -> Column:
    """Why a lone measure does not tell the content: it is multiplied, followed by a count of pieces, or beside a count of packs."""
    multiplied = F.size(_places(ts, ("digits", "times", "digits", "measure"))) > 0
    tail = ("digits", "measure", "digits", "count")
    counted = F.exists(_places(ts, tail), lambda i: (i + len(tail) == F.size(ts)) & ts[i + 2]["gap"])
    packed = F.exists(F.transform(ts, lambda t, i: t["text"].isin("pack") & t["begins"] & F.coalesce(F.get(ts, i + 1)["digits"], F.lit(False))), lambda x: x)
    return F.when(multiplied, "multiplied").when(counted, "pieces_counted").when(packed, "packs_counted")


STRUCTURE = "struct<tier:string,reason:string,bought:double,container:string,inner:double,inner_kind:string,size:double,unit:string,usable:double,usable_unit:string>"


def structure(text: Column) -> Column:
    """Struct of tier (`none` without one), reason (of none), bought, container, inner, inner_kind, size, unit, usable (in whole base units, one at least), usable_unit."""

    def parsed(ts: Column) -> Column:
        refused = _bare_refused(ts)
        found = [_best(rule, ts) for rule in RULES[:-1]]
        # a count behind "packs x" belongs to a container whose own count is missing: nothing can be told
        hanging = lambda r: F.coalesce((r["tier"] == "count_size") & F.get(ts, -r["back"] - 1)["times"] & F.get(ts, -r["back"] - 2)["container"], F.lit(False))
        bare = F.when(refused.isNull(), _best(RULES[-1], ts))

        def told(r: Column) -> Column:
            lost = r.isNull() | hanging(r)
            why = F.when(r.isNotNull() & hanging(r), "container_uncounted").when(r.isNull(), F.coalesce(refused, F.lit("no_measure")))
            usable = F.greatest(F.lit(1.0), F.floor(r["bought"] * F.coalesce(r["inner"], F.lit(1.0)) * (r["size"] * _base(r["unit"], 1)) + 0.5).cast("double"))
            kept = lambda c, none: F.when(~lost, c).otherwise(none)
            return F.struct(
                kept(r["tier"], F.lit("none")).alias("tier"), why.alias("reason"), kept(r["bought"], _no_number()).alias("bought"), kept(r["container"], _no_text()).alias("container"),
                kept(r["inner"], _no_number()).alias("inner"), kept(r["inner_kind"], _no_text()).alias("inner_kind"), kept(r["size"], _no_number()).alias("size"), kept(r["unit"], _no_text()).alias("unit"),
                kept(usable, _no_number()).alias("usable"), kept(_base(r["unit"], 0), _no_text()).alias("usable_unit"),
            )

        return _let(F.coalesce(*found, bare), told)

    return F.when(text.isNotNull(), _let(tokens(text), parsed))


def read_once(rows: DataFrame, name: str) -> DataFrame:
    """The rows with s, the structure of the text in the column name. Each distinct text is read once, in as many tasks as the session shuffles into or has cores for; null texts stay, with a null s."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # few bytes, but long to read: a fixed number of partitions is not merged into one; by the text itself it would be taken for the exchange of the distinct and left out
    distinct = rows.select(F.col(name).alias("_text")).where(F.col(name).isNotNull()).distinct().repartition(tasks, F.xxhash64("_text"))
    # a generator works the structure out once a row, however many of its fields are used
    read = distinct.select("_text", F.explode(F.array(structure(F.col("_text")))).alias("s"))
    return rows.join(read, rows[name] == read["_text"], "left").drop("_text")


def usable_cost(unit_price: Column, parsed: Column) -> Column:
    """Price of a kilogram, litre or piece of what the pack holds."""
    per = F.when(parsed["usable_unit"].isin("g", "ml"), 1000.0).otherwise(1.0)
    return F.when(parsed["usable"] > 0, unit_price / parsed["usable"] * per)


_CARTONS = ("caixa_units_size", "caixa_compact_size", "units_size")


def usable_of_row(parsed: Column, row_quantity: Column, row_unit: Column) -> Column:
    """What a line of row_quantity row_unit brings of a parsed pack: struct of containers, usable, source, weak.

    Rows repeat numbers of the name: an amount under a quarter of the piece, or one equal to a count in the name, is weak and does not scale the pack. A count of
    generic units scales packs whose name does not already multiply; a case count scales "24 x 80 g"; billed kilograms below the pack replace it.
    """
    row = F.struct(F.when(row_quantity > 0, row_quantity).alias("quantity"), F.lower(F.trim(row_unit)).alias("word"))
    return _let(F.struct(parsed.alias("s"), row.alias("row")), lambda both: _usable(both["s"], both["row"]["quantity"], both["row"]["word"]))


def _usable(s: Column, quantity: Column, word: Column) -> Column:
    measure, tier = _named(word, MEASURES), s["tier"]
    generic, cased = F.coalesce(word.isin("", *GENERIC_ROW_UNITS), F.lit(True)), F.coalesce(word.isin(*CASE_ROW_UNITS), F.lit(False))
    inner, many = F.coalesce(s["inner"], F.lit(1.0)), F.coalesce(s["inner"] > 1, F.lit(False))
    whole = F.greatest(F.lit(1.0), F.floor(quantity + 0.5).cast("double"))
    held = quantity * _base(measure, 1)
    piece = s["size"] * _base(s["unit"], 1)
    carton = many | tier.isin("count_size", *_CARTONS)
    sure = lambda c: F.coalesce(c, F.lit(False))
    weak = sure((_base(measure, 0) == _base(s["unit"], 0)) & ((held < piece * 0.25) | (carton & (held < s["usable"] * 0.25))))
    as_inner = sure(measure.isNotNull() & (F.abs(quantity - s["inner"]) < 0.01))
    as_bought = sure(measure.isNotNull() & tier.isin("count_size", "triple_nested", "container_size") & (F.abs(quantity - s["bought"]) < 0.01))
    final = generic & (tier.isin("count_size", *_CARTONS) | many)
    by_weight = sure((tier == "size_count") & (s["unit"] == "kg") & generic & (F.abs(quantity - inner) >= 0.01) & (F.abs(quantity - F.floor(quantity + 0.5)) > 0.001) & (quantity * 1000 < s["usable"] * 0.99))
    by_pack = sure((tier == "size_count") & (s["unit"] != "kg") & generic & (quantity > 1) & (F.abs(quantity - inner) >= 0.01))
    by_case = sure((tier == "count_size") & cased & (quantity > 1))
    named = F.greatest(F.lit(1.0), s["bought"])
    nested = many | tier.isin("triple_nested", *_CARTONS)
    containers = (
        F.when(quantity.isNull(), named)
        .when(nested, F.when(as_inner, named).when(~generic, named).when(by_weight, 1.0).when(by_pack, whole).when(final, 1.0).otherwise(whole))
        .when(tier == "count_size", F.when(as_bought, named).when(by_case, whole).when(generic, 1.0).otherwise(named))
        .when((tier == "container_size") & (named > 1), F.when(weak, F.greatest(named, whole)).otherwise(named))
        .when(generic, whole).otherwise(named)
    )

    def total(n: Column) -> Column:
        scaled = F.when(n == named, s["usable"]).otherwise(F.greatest(F.lit(1.0), F.floor(s["usable"] * (n / named) + 0.5).cast("double")))
        part = weak & sure(held < s["usable"] * 0.25)
        told = lambda amount, source: F.struct(amount.alias("usable"), F.lit(source).alias("source"))
        in_nested = (
            F.when(as_bought, told(s["usable"], "name")).when(part, told(held, "row_part")).when(by_weight, told(quantity * 1000, "row_weight")).when(by_pack, told(scaled, "scaled"))
            .when(as_inner | (n == s["bought"]) | final, told(s["usable"], "name")).otherwise(told(scaled, "scaled"))
        )
        in_count = F.when(as_bought, told(s["usable"], "name")).when(part, told(held, "row_part")).when(by_case, told(whole * s["usable"], "scaled")).otherwise(told(s["usable"], "name"))
        plain = (
            F.when(as_bought | weak, told(s["usable"], "name")).when(generic & quantity.isNotNull(), told(whole * piece, "recomputed"))
            .when(n == s["bought"], told(s["usable"], "name")).otherwise(told(scaled, "scaled"))
        )
        found = F.when(nested, in_nested).when(tier == "count_size", in_count).otherwise(plain)
        return F.struct(n.alias("containers"), F.greatest(F.lit(1.0), F.floor(found["usable"] + 0.5).cast("double")).alias("usable"), found["source"].alias("source"), (weak | as_inner | as_bought).alias("weak"))

    return F.when(s["usable"] > 0, _let(containers, total))
