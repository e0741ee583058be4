"""Personal data: fixed patterns, and terms that give a protected entity away.

The patterns find the base spans. What they find are the protected entities. Following
the information content of terms, IC(e) = -log2 p(e) is what naming an entity tells,
and PMI(t, e) = log2 p(t, e) / (p(t) p(e)) is how much of it a term tells, where
probabilities are shares of different texts: a text counts once, however many copies
it has, and term and entity meet anywhere in it. A term discloses an entity when PMI
reaches ``generalise`` of IC: it is then replaced by a class of terms, and from
``remove`` on it is taken out, in all documents, also where no entity is named. For an
entity that one of N texts names, a share g is reached by terms in up to N^(1-g) texts:
those that lead to that text.

DataFrame expressions only. Positions come from splitting a text at its matches and
adding lengths up; the patterns are possessive but for the phone's, which gives back no
more than a run of its own characters. Entities that the same texts name are one class,
so that a text with thousands of entities of its own does not multiply its terms. A
term is looked for in all texts only where it can reach the threshold: the count with the
class gives the most texts it may stand in, and two bounds from below how many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.arrays import before_each, let, placed, sums_before
from opsframe.operators.lookup import weighted_lookup
from opsframe.sources.durable import settle

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
GENERALISE = 0.9
REMOVE = 0.95
WITNESSES = 1
#: So many of the most frequent terms that disclose nothing are dropped before the shuffle
#: that finds the others; a fixed number, so what is broadcast for it does not grow.
MOST_FREQUENT = 1 << 18
MASK_WORDS = 4  # of 64 bits, for each term

# The fixed patterns. A match cannot start inside a run of its first class unless the
# match before ended there, so the search never starts again in the middle of one.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no valid match of the kind.
_NEEDS = {
    "email": "[A-Za-z0-9._%+-]@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": "[0-9](?:[ -]?[0-9]){13}",
    "phone": r"\+[0-9]",
}
# A term is a run of letters and digits.
_NOT_TERM = r"[^\p{L}\p{N}]++"
_PIECE = r"[^\p{L}\p{N}]*+[\p{L}\p{N}]++"
_ANY = "|".join(_NEEDS.values())
_TEXT = "text_key"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts twice."""
    reverse = F.split(F.reverse(digits), "")
    each = F.transform(
        reverse,
        lambda d, i: F.when(d == "", 0)
        .when(i % 2 == 0, d.cast("int"))
        .otherwise(F.floor(d.cast("int") * 2 / 10).cast("int") + (d.cast("int") * 2) % 10),
    )
    return F.aggregate(each, F.lit(0), lambda total, n: total + n) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # Parts may be longer than any number type: leading zeros go first.
        return F.forall(F.split(match, "\\."), lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (
            F.coalesce(F.right(part, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(match))
    if kind == "phone":
        return n.between(10, 15)
    return n.between(14, 19) & F.when(n.between(14, 19), _luhn(_digits(match))).otherwise(False)


_SPAN = "struct<start:long,kind:int,end:long,value:string>"


def kind_spans(text: Column, kind: str) -> Column:
    """The valid matches of a kind: structs of start, kind, end and the matched value."""
    order = F.lit(KINDS.index(kind))

    def span(start: Column, match: Column) -> Column:
        end = start + F.length(match)
        return F.struct(start.alias("start"), order.alias("kind"), end.alias("end"), match.alias("value"))

    valid = F.filter(placed(text, PATTERNS[kind], span), lambda s: _valid(kind, s["value"]))
    return F.when(F.regexp_like(text, F.lit(_NEEDS[kind])), valid).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    return F.array_sort(F.concat(*[kind_spans(text, kind) for kind in KINDS]))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
    )


def _entity(span: Column) -> Column:
    """What is protected: the kind and the value without its writing."""
    digits = span["kind"].isin(KINDS.index("card"), KINDS.index("phone"))
    return F.xxhash64(span["kind"], F.when(digits, _digits(span["value"])).otherwise(F.lower(span["value"])))


def _identity(text: Column) -> Column:
    return F.xxhash64(text).alias(_TEXT)


def _key(term: Column) -> Column:
    return F.xxhash64(F.lower(term)).alias("term")


def _words(text: Column) -> Column:
    """The terms of a text and perhaps an empty one."""
    return F.split(text, _NOT_TERM)


def term_places(docs: DataFrame) -> DataFrame:
    """(text_key, term, start, end) for every term of every text.

    A text is cut behind each term; the lengths of the pieces add up to the places.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    ends = lambda p: let(F.transform(p, lambda x: F.length(x).cast("long")), sums_before)
    zipped = let(pieces, lambda p: F.arrays_zip(p.alias("piece"), ends(p).alias("begin")))
    found = docs.select(_identity(text), F.explode(zipped).alias("p"))
    piece, begin = F.col("p.piece"), F.col("p.begin")
    found = found.select(_TEXT, F.regexp_extract(piece, r"[\p{L}\p{N}]++$", 0).alias("_word"), (begin + F.length(piece)).cast("int").alias("end"))
    return found.select(_TEXT, _key(F.col("_word")), (F.col("end") - F.length("_word")).alias("start"), "end")


def entity_classes(rows: DataFrame) -> DataFrame:
    """(class, n_entity, text_key): the texts of each class of entities.

    Entities named by the same texts have the same frequencies with every term; they
    are told apart by two exclusive ors of hashes of their texts.
    """
    named = settle(rows.select(_TEXT, F.explode("spans").alias("s")).select(_entity(F.col("s")).alias("entity"), _TEXT).distinct())
    both = F.bit_xor(_TEXT).alias("_one"), F.bit_xor(F.xxhash64(_TEXT)).alias("_other")
    facts = settle(named.groupBy("entity").agg(F.count("*").alias("n_entity"), *both))
    kept = facts.groupBy("n_entity", "_one", "_other").agg(F.min("entity").alias("entity"))
    kept = settle(kept.select("entity", F.col("entity").alias("class"), "n_entity", F.col("n_entity").alias("_n")))
    return settle(weighted_lookup(named, kept, ["entity"], "_n").select("class", "n_entity", _TEXT))


def disclosing_terms(
    docs: DataFrame, rows: DataFrame, generalise: float, remove: float, witnesses: int
) -> DataFrame:
    """(text_key, start, end, removed) of each term, in any text, that gives an entity away.

    ``docs`` holds text, ``rows`` the base spans and the identity of the same texts.
    """
    n_rows, n_texts = rows.agg(F.count("*"), F.count_distinct(_TEXT)).first()
    total, copies = float(max(n_texts, 1)), n_rows - n_texts
    classes = entity_classes(rows)
    text = F.coalesce("text", F.lit(""))
    # Documents that hold each term, and a mask of the texts it stands in. Of the texts, it
    # stands in as many as the mask has bits at least, and in as many as its documents less
    # all further copies of any text.
    held = docs.select(_identity(text), F.explode(F.array_distinct(_words(text))).alias("_word"))
    held = held.where("_word <> ''").select(_TEXT, _key(F.col("_word")))
    place = F.pmod(_TEXT, F.lit(64 * MASK_WORDS))
    bit = F.expr(f"shiftleft(1L, cast(pmod({_TEXT}, 64) as int))")
    words = [F.bit_or(F.when(F.floor(place / 64) == i, bit).otherwise(0)) for i in range(MASK_WORDS)]
    texts = sum((F.bit_count(word) for word in words), F.lit(0)).cast("long")
    least = F.greatest(texts, F.count("*") - copies)
    seen = settle(held.groupBy("term").agg(F.count("*").alias("n"), least.alias("least")))
    # The texts that name an entity: how many of a class hold each term.
    naming = docs.where(F.regexp_like(text, F.lit(_ANY))).select(_identity(text), F.explode(F.array_distinct(_words(text))).alias("_word"))
    naming = naming.where("_word <> ''").select(_TEXT, _key(F.col("_word"))).distinct()
    joint = settle(classes.join(naming, _TEXT).groupBy("class", "n_entity", "term").agg(F.count("*").alias("n_joint")))
    joint = joint.where(F.col("n_joint") >= witnesses)
    # PMI reaches the share of IC only for terms in so many texts.
    ceiling = F.col("n_joint") * F.pow(F.lit(total) / F.col("n_entity"), F.lit(1 - generalise)) * (1 + 1e-9)
    wanted = joint.groupBy("term").agg(F.max(ceiling).alias("_ceiling")).join(seen, "term")
    wanted = settle(wanted.where(F.col("least") <= F.col("_ceiling")).select("term"))
    frequent = seen.join(wanted, "term", "left_anti").orderBy(F.col("n").desc(), "term").limit(MOST_FREQUENT).select("term")
    places = term_places(docs).join(F.broadcast(frequent), "term", "left_anti").join(wanted, "term")
    places = settle(places.distinct())  # copies of a text are one
    n_term = places.select("term", _TEXT).distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    information = F.log2(F.lit(total) / F.col("n_entity"))
    pmi = F.log2(F.col("n_joint") * total / (F.col("n_entity") * F.col("n_term")))
    told = F.when(information > 0, pmi / information)
    telling = joint.join(n_term, "term").withColumn("told", told)
    telling = telling.where(F.col("told") >= generalise - 1e-12).groupBy("term")
    telling = telling.agg((F.max("told") >= remove - 1e-12).alias("removed"))
    return places.join(telling, "term").select(_TEXT, "start", "end", "removed")


def _sanitised(text: Column, spans: Column, names: Column) -> Column:
    """The text with each span replaced by its name; what overlaps an earlier span goes with it."""
    ends = F.transform(spans, lambda s: s["end"])
    part = lambda start, n: F.substring(text, (start + F.lit(1)).cast("int"), n.cast("int"))

    def written(at: Column, s: Column) -> Column:
        name = F.when(s["kind"] == len(KINDS), F.when(s["value"] == "removed", "").otherwise("[TERM]")).otherwise(F.get(names, s["kind"]))
        return F.when(s["start"] < at, F.lit("")).otherwise(F.concat(part(at, s["start"] - at), name))

    parts = F.zip_with(let(ends, lambda x: before_each(x, lambda a, v: F.greatest(a, v))), spans, written)
    last = F.coalesce(F.array_max(ends), F.lit(0).cast("long"))
    return F.concat(F.array_join(parts, ""), part(last, F.length(text)))


def personal_data(
    docs: DataFrame,
    with_text: bool = True,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    witnesses: int = WITNESSES,
) -> DataFrame:
    """One row per document: doc_id, base_spans, spans (with the terms added), and sanitised text.

    Spans are structs of start, kind (its place in KINDS, then the term), end and the
    value; places are code points, the end exclusive. Terms are runs of letters and
    digits of any length, compared in lower case, those inside an entity included; none
    that overlaps a base span is added. A term tells an entity only when ``witnesses`` different texts hold both.
    ``sanitised`` names the kind in the place of a base span and of a generalised term
    and omits removed terms; it is left out without ``with_text``. Null counts as empty
    text, which has no spans; null doc_ids and repeated rows are documents of their
    own; texts of any length are read whole; an empty table gives an empty result;
    other columns are not read. Texts and terms are counted by 64 bits of hash.
    """
    text = F.coalesce("text", F.lit(""))
    more = [text.alias("text")] if with_text else []
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _identity(text), base_spans(text).alias("spans"), *more))
    terms = disclosing_terms(docs, rows, generalise, remove, witnesses)
    added = F.struct(
        F.col("start").cast("long").alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("end").cast("long").alias("end"),
        F.when(F.col("removed"), "removed").otherwise("general").alias("value")
    )
    terms = terms.groupBy(_TEXT).agg(F.collect_list(added).alias("_terms"))  # of one text
    facts = settle(rows.groupBy(_TEXT).agg(F.count("*").alias("_n")).join(terms, _TEXT, "left"))
    every = weighted_lookup(rows, facts, [_TEXT], "_n")
    none = F.array().cast(f"array<{_SPAN}>")
    free = lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"]))
    own = F.when(F.size("spans") > 0, F.filter("_terms", free)).otherwise(F.col("_terms"))
    every = every.withColumn("all_spans", F.array_sort(F.concat("spans", F.coalesce(own, none))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    clean = [_sanitised(F.col("text"), F.col("all_spans"), names).alias("sanitised")] if with_text else []
    return every.select("doc_id", F.col("spans").alias("base_spans"), F.col("all_spans").alias("spans"), *clean)


def span_digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
