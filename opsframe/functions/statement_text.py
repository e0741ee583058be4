"""Native expressions over statement text: find table references, remove schemas.

Everything works inside one row, so a job built on these needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe.functions.arrays import let, states, sums_before

# A statement as strings, delimited names, comments and plain runs. A doubled
# quote inside a string simply ends one token and starts the next.
_TOKEN = r"""(?s)'[^']*'?|"[^"]*"?|--[^\n]*|/\*.*?(?:\*/|$)|[^'"/\-]+|."""

_WORD = r"[\p{L}_$#@][\p{L}\p{N}_$#@]*+"
_PART = rf'(?:{_WORD}|(?:"[^"]*+")++)'
_EDGE = r"(?<![\p{L}\p{N}_$#@.])"
_END = r"(?![\p{L}\p{N}_$#@])"
_NOT_A_TABLE = rf"(?!(?:set|select|values|lateral|final|old|new|unnest|with){_END})"
_NAME = rf"{_NOT_A_TABLE}{_PART}(?:\s*+[./]\s*+{_PART})*+"

# Where the meaning of a comma may change: a bracket, or a word that begins a clause.
_ENDS_LIST = (
    "where|group|having|order|fetch|for|union|except|intersect|minus|window|limit|offset|set|values|when|start|connect|with|optimize"
)
_CLAUSE = rf"(?=[c-ilmosu-w]){_EDGE}(?:from(?<!distinct\s{{1,9}}from)|select|delete|{_ENDS_LIST}){_END}"
# What stands between two cuts, taken word by word: only at the start of a word is anything looked for.
_RUN = r"[\p{L}\p{N}_$#@.]++"
_SEGMENT = rf"(?is)(?=.)(?:[()]|{_CLAUSE})?+(?:[^\p{{L}}\p{{N}}_$#@.()]++|(?!{_CLAUSE}){_RUN})*+"
_FIRST = r"^(?:[()]|[\p{L}\p{N}_$#@]++)"
# A bracket around joined tables: their list starts at the bracket.
_JOINED = rf"(?i)^\(\s*+{_NAME}(?:\s+(?:as\s+)?{_PART})??\s+(?:cross|inner|left|right|full|natural|join){_END}"
_LEAD = rf"(?i)(?:{_EDGE}(?:from(?<!distinct\s{{1,9}}from)|join|(?:insert|merge)\s+into|update(?<!for\s{{1,9}}update)|using){_END}\s*+|,\s*+)(?:(?:only|final\s+table){_END}\s*+)?+"
_REFERRED = rf"(?:(?<=into\s{{1,9}}|update\s{{1,9}}){_NAME}|{_NAME}(?!\s*+\())"
# What leads to the next reference, word by word, and its name; at the end of the text no name.
_NEXT = rf"(?is)((?:(?!(?=[fijmu,]){_LEAD}{_REFERRED})(?:{_RUN}|[^\p{{L}}\p{{N}}_$#@.,]++|,))*+(?:{_LEAD})?+)((?:{_REFERRED})?+)"
_PARTS = "\u0000"
_LED_BY_USING = rf"(?i){_EDGE}using{_END}\s*+(?:(?:only|final\s+table){_END}\s*+)?+\z"
_CTE = rf"(?i){_EDGE}({_PART})\s*+(?:\([^()]*\)\s*+)?as\s*+(?:(?:not\s+)?materialized\s*+)?\("
_HAS_CTE = rf"(?i){_EDGE}with{_END}"

REFERENCE_TYPE = "array<struct<schema:string,name:string,name_start_position:int>>"

GUARDED_SEPARATOR = r" *[.|/] *"
SIMPLE_SEPARATOR = r"\."
MODES = ("null", "stop", "skip")


def mask_text(text: Column) -> Column:
    """The text with strings and comments blanked, character positions unchanged.

    What stands between the quotes of a delimited name becomes a line of underscores, so
    that a bracket or a word in it means nothing.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))

    def blank(t: Column) -> Column:
        first, size = F.left(t, F.lit(1)), F.length(t)
        hidden = (first == "'") | F.left(t, F.lit(2)).isin("--", "/*")
        name = F.concat(F.lit('"'), F.repeat(F.lit("_"), size - 2), F.lit('"'))
        closed = (first == '"') & (size > 1) & F.endswith(t, F.lit('"'))
        return F.when(hidden, F.repeat(F.lit(" "), size)).when(closed, name).otherwise(t)

    # Most texts have nothing to hide.
    hides = F.contains(text, F.lit("'")) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("--")) | F.contains(text, F.lit("/*"))
    return F.when(hides, F.array_join(F.transform(tokens, blank), "")).otherwise(text)


# What a segment begins with; the numbers order nothing.
_OTHER, _SELECT, _FROM, _LIST_END, _OPEN, _OPEN_LIST, _CLOSE = range(7)


def _code(segment: Column) -> Column:
    """The kind of a segment by its first word or bracket."""

    def kind(first: Column) -> Column:
        return (
            F.when(first == "(", F.when(segment.rlike(_JOINED), _OPEN_LIST).otherwise(_OPEN))
            .when(first == ")", _CLOSE)
            .when(first == "from", _FROM)
            .when(first.isin("select", "delete"), _SELECT)
            .when(first.isin(*_ENDS_LIST.split("|")), _LIST_END)
            .otherwise(_OTHER)
        )

    return let(F.lower(F.regexp_extract(segment, _FIRST, 0)), kind)


def _in_list(codes: Column) -> Column:
    """For each segment of one bracket after the other whether commas part tables in it.

    FROM begins a list of tables when a SELECT or DELETE stands before it in the same
    bracket, and not another FROM: those of ``extract(year from x)`` and ``fetch from c``
    do not. A list ends with a word that begins another clause.
    """
    opens = (_SELECT, _FROM, _OPEN, _OPEN_LIST)

    def step(s: Column, c: Column) -> Column:
        changes = ((c != _FROM) | (s["last"] == _SELECT)) & c.isin(*opens, _LIST_END)
        listing = F.when(changes, c.isin(_FROM, _OPEN_LIST)).otherwise(s["listing"])
        return F.struct(F.when(c.isin(*opens), c).otherwise(s["last"]).alias("last"), listing.alias("listing"))

    return states(codes, F.struct(F.lit(_OTHER).alias("last"), F.lit(False).alias("listing")), step, "listing")


def segment_array(masked: Column) -> Column:
    """The masked text cut at brackets and clause words, each piece with its kind."""
    return F.transform(F.regexp_extract_all(masked, F.lit(_SEGMENT), F.lit(0)), lambda s: F.struct(_code(s).alias("code"), s.alias("text")))


def marked_text(masked: Column, found: Column) -> Column:
    """The masked text with the commas that part no tables, and the FROMs that begin no
    list, replaced by others of their length; ``found`` are its segments.

    A running sum over the brackets is the depth; put in the order of depth, the segments
    of one bracket stand together, and what a segment means depends on the last events
    before it.
    """

    def by_depth() -> Column:
        steps = F.transform(found, lambda s: F.when(s["code"].isin(_OPEN, _OPEN_LIST), 1).when(s["code"] == _CLOSE, -1).otherwise(0).cast("long"))
        depths = F.zip_with(let(steps, sums_before), steps, lambda b, s: b + s)
        numbered = F.transform(found, lambda s, i: F.struct(i.alias("i"), s["code"].alias("c")))
        return F.sort_array(F.zip_with(depths, numbered, lambda d, s: F.struct(d.alias("d"), s["i"].alias("i"), s["c"].alias("c"))))

    def rewritten(ordered: Column) -> Column:
        codes = F.transform(ordered, lambda o: o["c"])
        flags = F.zip_with(ordered, let(codes, _in_list), lambda o, f: F.struct(o["i"].alias("i"), f.alias("f")))
        return F.zip_with(found, F.transform(F.sort_array(flags), lambda x: x["f"]), written)

    def written(segment: Column, listing: Column) -> Column:
        text = segment["text"]
        quiet = F.replace(F.when(segment["code"] == _FROM, F.overlay(text, F.lit("...."), F.lit(1))).otherwise(text), F.lit(","), F.lit(";"))
        listed = F.when(segment["code"] == _OPEN_LIST, F.overlay(text, F.lit(","), F.lit(1))).otherwise(text)
        return F.when(listing, listed).otherwise(quiet)

    # Without brackets the order of depth is that of the text.
    plain = let(found["code"], lambda codes: F.zip_with(found, _in_list(codes), written))
    brackets = F.contains(masked, F.lit("(")) | F.contains(masked, F.lit(")"))
    return F.array_join(F.when(brackets, let(by_depth(), rewritten)).otherwise(plain), "")


def reference_pieces(marked: Column) -> Column:
    """The marked text in pieces, two for a reference: what leads to it, and its name."""
    # One pass of the pattern: the pieces are parted by a character that is not in the text.
    parted = F.regexp_replace(F.replace(marked, F.lit(_PARTS), F.lit("\u0001")), _NEXT, f"$1{_PARTS}$2{_PARTS}")
    return F.split(parted, _PARTS)


def piece_spans(masked: Column, pieces: Column) -> Column:
    """Where the names of the pieces stand: place, size, and whether USING leads to them."""
    # A word that is nowhere in a text need not be looked for by a pattern.
    has_using = F.contains(F.lower(masked), F.lit("using"))

    def paired() -> Column:
        pairs = F.sequence(F.lit(0), F.greatest(F.size(pieces) - 3, F.lit(0)), F.lit(2))
        both = F.transform(pairs, lambda i: F.struct(F.get(pieces, i).alias("lead"), F.get(pieces, i + 1).alias("name")))
        return F.when(pieces.isNotNull(), let(both, pieced))

    def pieced(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda p: (F.length(p["lead"]) + F.length(p["name"])).cast("long"))
        led = lambda using: F.zip_with(let(lengths, sums_before), pairs, lambda before, pair: of(before, pair, using))
        return F.filter(let(has_using, led), lambda s: s["size"] > 0)

    def of(before: Column, pair: Column, using: Column) -> Column:
        return F.struct(
            (before + F.length(pair["lead"]) + 1).cast("int").alias("place"),
            F.length(pair["name"]).alias("size"),
            (using & F.regexp_like(pair["lead"], F.lit(_LED_BY_USING))).alias("using"),
        )

    return paired()


def span_references(masked: Column, given: Column, spans: Column) -> Column:
    """The references at the spans, without names of common table expressions."""

    def part(name: Column) -> Column:
        plain = F.replace(F.substring(name, F.lit(2), F.length(name) - 2), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(name, F.lit('"')), plain).otherwise(F.upper(name))

    def named(s: Column) -> Column:
        parts = F.regexp_extract_all(F.substring(given, s["place"], s["size"]), F.lit(_PART), F.lit(0))
        return let(F.struct(parts.alias("parts"), s["place"].alias("place"), s["using"].alias("using")), reference)

    def reference(r: Column) -> Column:
        n = F.size(r["parts"])
        return F.struct(
            F.when(n > 1, part(F.get(r["parts"], n - 2))).alias("schema"),
            part(F.get(r["parts"], n - 1)).alias("name"),
            r["place"].alias("name_start_position"),
            r["using"].alias("using"),
        )

    said = F.lower(masked)
    merge = F.contains(said, F.lit("merge")) & F.regexp_like(masked, F.lit(r"(?i)\bmerge\s+into\b"))
    ctes = F.transform(F.regexp_extract_all(given, F.lit(_CTE), F.lit(1)), part)
    none = F.array().cast("array<string>")
    own = F.when(F.contains(said, F.lit("with")) & masked.rlike(_HAS_CTE), ctes).otherwise(none)
    tables = F.transform(F.filter(spans, lambda s: ~s["using"] | merge), named)
    tables = let(own, lambda names: F.filter(tables, lambda r: r["schema"].isNotNull() | ~F.array_contains(names, r["name"])))
    return F.transform(tables, lambda r: r.dropFields("using")).cast(REFERENCE_TYPE)


def reference_array(masked: Column, text: Column | None = None) -> Column:
    """Table references of a masked text in text order.

    Names come from ``text`` (the masked one if it is not given): ordinary identifiers
    are folded to upper case, delimited ones are taken as they are; the schema is the
    part before the name and null when absent; positions are 1-based and point at the
    qualified name. Names of common table expressions are no tables and are left out.
    """
    given = masked if text is None else text
    # Each step is named once, so that it is computed once.
    marked = let(segment_array(masked), lambda found: marked_text(masked, found))
    spans = let(let(marked, reference_pieces), lambda pieces: piece_spans(masked, pieces))
    return let(spans, lambda found: span_references(masked, given, found)).cast(REFERENCE_TYPE)


def remove_first(text: Column, schema: Column, separator: str = GUARDED_SEPARATOR, whole_word: bool = False) -> Column:
    """Remove the first ``schema`` + separator, ignoring case; null schema gives null.

    Spark's ``regexp_replace`` replaces every match; anchoring the pattern at the
    start of the text leaves exactly one. The schema is matched literally.
    """
    quoted = F.replace(schema, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    edge = r"(?<![\p{L}\p{N}_$#@])" if whole_word else ""
    pattern = F.concat(F.lit(rf"(?is)^(.*?){edge}\Q"), quoted, F.lit(rf"\E{separator}"))
    return F.regexp_replace(text, pattern, F.lit("$1"))


def strip_chain(
    text: Column,
    schemas: Column,
    mode: str,
    separator: str = GUARDED_SEPARATOR,
    keep: Column | None = None,
    whole_word: bool = False,
) -> Column:
    """Apply ``remove_first`` for each schema of an array, in order.

    ``mode`` says what a null schema does: ``"null"`` makes the text null,
    ``"stop"`` leaves the first reference alone and ends the chain at any later
    one, ``"skip"`` passes over it. Schemas in the array ``keep`` are passed over.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")

    def strip(current: Column, schema: Column) -> Column:
        stripped = remove_first(current, schema, separator, whole_word)
        return stripped if keep is None else F.when(F.array_contains(keep, schema), current).otherwise(stripped)

    if mode == "null":
        return F.reduce(schemas, text, strip)
    if mode == "skip":
        return F.reduce(F.filter(schemas, lambda s: s.isNotNull()), text, strip)
    # "stop": everything before the first null that is not the leading one.
    leading_null = F.get(schemas, F.lit(0)).isNull()
    rest = F.when(leading_null, F.slice(schemas, 2, F.greatest(F.size(schemas) - 1, F.lit(0)))).otherwise(schemas)
    first_null = F.array_position(F.transform(rest, lambda s: s.isNull()), F.lit(True))
    chain = F.when(first_null == 0, rest).otherwise(F.slice(rest, F.lit(1), (first_null - 1).cast("int")))
    return F.reduce(chain, text, strip)
