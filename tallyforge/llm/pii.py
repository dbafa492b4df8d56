"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. They are the protected entities. A term, a run of letters, that keeps
company with an entity may reveal it even where the entity itself is masked. The corpus says how much: with documents as units,

    IC(e) = -log2 p(e)        PMI(e, t) = log2 p(e, t) / (p(e) p(t))        disclosure(e, t) = PMI(e, t) / IC(e)

where p(e, t) counts the documents in which t stands within `window` characters of e, and p(t) those that hold t, `prior` of a document more. A disclosure near 1
means that t occurs hardly but beside e and gives it away; one of 0.9 that t narrows e down to about the tenth root of the corpus. Terms whose disclosure reaches
`threshold`, with at least `support` different texts as evidence, are generalised (replaced by a class) in every document that holds the entity, and removed at
`removal` or more. An entity that occurs once needs no more evidence than that: a name beside a one-off address and nowhere else is told by it.

Spans count code points, end exclusive. Every pattern is matched leftmost and without overlap; a match that fails its test is dropped and
not tried again. Patterns are written so that they neither recurse nor rescan long runs, and match what the plain patterns match.

Defined results: a null text has no spans and stays null; an empty one has none; repeated rows get equal spans, and exact copies of a text
are one text of evidence; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.textcore import written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: Each is the plain pattern with possessive groups; the guards in front only keep the search from restarting inside a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARK, STAND_IN = "\u0001", "\u0002"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


@dataclass(frozen=True)
class PiiParams:
    """window: characters on either side of an entity. support: different texts that must show the pair. prior: documents added to a term's count. threshold, removal: disclosures."""

    window: int = 80
    support: int = 1
    prior: float = 0.5
    threshold: float = 0.9
    removal: float = 0.97
    least_letters: int = 3


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(F.try_to_number(F.when(F.length(bare).between(1, 3), bare), F.lit("999")), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["value"])


def _matches(text: Column, pattern: Column | str, kind: str) -> Column:
    """Spans of the pattern's matches: the text is cut at marks set around each, and the lengths of the parts are summed."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK)

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), part.alias("value"))
        spans = F.when(acc["inside"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), spans.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit(None).cast(SPAN).alias("spans"))
    begin = begin.withField("spans", F.array().cast(SPAN))
    return F.aggregate(parts, begin, step, lambda acc: acc["spans"])


def with_base_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with base_spans: array of (kind, start, end, value) by kind as listed, then start."""
    safe = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, STAND_IN)
    none = F.array().cast(SPAN)
    found = []
    for kind in KINDS:
        sign = {"email": F.contains(safe, F.lit("@")), "phone": F.contains(safe, F.lit("+"))}.get(kind, F.rlike(safe, F.lit("[0-9]")))
        spans = F.filter(_matches(safe, PATTERNS[kind], kind), _test(kind))
        found.append(F.when(sign & F.rlike(safe, F.lit(PATTERNS[kind])), spans).otherwise(none))
    return documents.withColumn("base_spans", F.concat(*found))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _terms(text: Column, params: PiiParams) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= params.least_letters)


def disclosures(spanned: DataFrame, documents: DataFrame, params: PiiParams = PiiParams(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """entity, term, disclosure of every pair at or over the threshold; spanned: the documents that have base_spans.

    Pairs are gathered only around entities. The documents of each term are counted over the whole corpus, in every task first.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    one = spanned.where(F.size("base_spans") > 0).select(F.col(key).alias("unit"), F.xxhash64(body).alias("text_hash"), body.alias("body"), F.explode("base_spans").alias("span"))
    left_at = F.greatest(F.lit(0), F.col("span.start") - params.window)
    left = F.substring(F.col("body"), left_at + 1, F.col("span.start") - left_at)
    right = F.substring(F.col("body"), F.col("span.end") + 1, F.lit(params.window))
    left = F.when(left_at > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.length(right) == params.window, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    beside = F.concat_ws(" ", left, right)
    for kind in KINDS:
        beside = F.regexp_replace(beside, PATTERNS[kind], " ")
    near = one.select(_entity(F.col("span")).alias("entity"), "unit", "text_hash", _terms(beside, params).alias("terms"))
    pairs = near.select("entity", "unit", "text_hash", F.explode("terms").alias("term")).distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.countDistinct("text_hash").alias("n_texts")).where(F.col("n_texts") >= params.support)
    entities = near.select("entity", "unit").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    words = documents.select(F.explode(_terms(body, params)).alias("term"))
    held = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n = F.lit(float(documents.count()))
    both = pairs.join(held, "term").join(entities, "entity")
    # Beside a masked entity's remains a term can be shorter than in the text itself, so its own count may be the smaller.
    pmi = F.log2(F.col("n_both") * n / (F.col("n_entity") * (F.greatest(F.col("n_term"), F.col("n_both")) + params.prior)))
    share = F.when(n > F.col("n_entity"), pmi / F.log2(n / F.col("n_entity"))).otherwise(F.lit(0.0))
    return both.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= params.threshold)


def with_spans(documents: DataFrame, params: PiiParams = PiiParams(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows with base_spans, and term_spans whose value is `generalise` or `remove`.

    No column may have one of these names or begin with an underscore; `sanitise` takes any.
    """
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    own = [F.col(key).alias("_key"), F.col("_mark"), F.col(text).alias("_body")]
    # The patterns run once: rows that have spans are written, and all that follows starts from them.
    some = with_base_spans(documents.withColumn("_mark", mark).select(*own), "_body").where(F.size("base_spans") > 0)
    some = written(some, "spans")
    found = disclosures(some, documents.select(F.col(text).alias("_body")), params, "_body", "_key")
    held = some.select("_key", "_mark", F.explode(F.array_distinct(F.transform("base_spans", _entity))).alias("entity"))
    told = held.join(found, "entity").groupBy("_key", "_mark", "term").agg(F.max("disclosure").alias("disclosure"))
    told = told.groupBy(F.col("_key").alias("_k"), F.col("_mark").alias("_m")).agg(
        F.concat_ws("|", F.sort_array(F.collect_list("term"))).alias("_terms"),
        F.concat_ws("|", F.sort_array(F.collect_list(F.when(F.col("disclosure") >= params.removal, F.col("term"))))).alias("_gone"),
    )
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m"))
    rows = some.dropDuplicates(["_key", "_mark"]).join(told, same, "left")
    safe = F.translate(F.coalesce(F.col("_body"), F.lit("")), MARK, STAND_IN)
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("_terms"), F.lit(r")(?!\p{L})"))
    spans = F.when(F.col("_terms").isNotNull(), _matches(safe, pattern, TERM)).otherwise(F.array().cast(SPAN))
    gone = F.split(F.coalesce(F.col("_gone"), F.lit("")), r"\|")
    spans = F.transform(spans, lambda s: s.withField("value", F.when(F.array_contains(gone, F.lower(s["value"])), "remove").otherwise("generalise")))
    spanned = rows.select(F.col("_key").alias("_k"), F.col("_mark").alias("_m"), "base_spans", spans.alias("term_spans"))
    none = F.array().cast(SPAN)
    out = documents.withColumn("_mark", mark).join(spanned, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m")), "left")
    kept = [F.col(c) for c in documents.columns]
    return out.select(*kept, F.coalesce("base_spans", none).alias("base_spans"), F.coalesce("term_spans", none).alias("term_spans"))


def sanitised(spanned: DataFrame, text: str = "text") -> DataFrame:
    """The rows of with_spans with the text rewritten: entities become [KIND], terms [TERM] or nothing. Of overlapping spans the first counts."""
    marks = F.transform(F.col("base_spans"), lambda s: s.withField("value", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    terms = F.transform(F.col("term_spans"), lambda s: s.withField("value", F.when(s["value"] == "remove", "").otherwise("[TERM]")))
    order = F.transform(F.concat(marks, terms), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["value"].alias("value")))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), s["value"])
        skip = s["start"] < acc["at"]
        return F.struct(F.when(skip, acc["at"]).otherwise(-s["back"]).alias("at"), F.when(skip, acc["out"]).otherwise(kept).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.array_sort(order), begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return spanned.withColumn(text, F.when(F.size("base_spans") + F.size("term_spans") > 0, whole).otherwise(F.col(text)))


def sanitise(documents: DataFrame, params: PiiParams = PiiParams(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with their texts sanitised, and the columns they came with, whatever their names; n_chars, if there, follows the text."""
    others = [c for c in documents.columns if c != text]
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("body"), F.struct(*others).alias("others"))
    out = sanitised(with_spans(rows, params, "body", "key"), "body")
    back = {c: F.col("others")[c] for c in others} | {text: F.col("body")}
    if "n_chars" in others:
        back["n_chars"] = F.when(F.col("body").isNotNull(), F.length("body")).otherwise(back["n_chars"]).cast(documents.schema["n_chars"].dataType)
    return out.select(*[back[c].alias(c) for c in documents.columns])


def counted(spans: Column, kind: str) -> Column:
    """How many of the spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
