"""Statement texts: table references, schema stripping, fingerprints.

Two ways lead to the same results. ``table_references`` gives one row per
reference, and ``strip_references`` regroups such rows, whatever made them.
``strip_statements`` and ``audit_statements`` do the same work inside each
statement's row: no exchange, and no copy of the text per reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.statement_text import (
    GUARDED_SEPARATOR,
    SIMPLE_SEPARATOR,
    mask_text,
    marked_text,
    piece_spans,
    reference_pieces,
    segment_array,
    span_references,
    strip_chain,
)
from opsframe.operators.lookup import weighted_lookup
from opsframe.sources.durable import settle

# Schemas that are the same on every system and stay in place.
STATIC_SCHEMAS = ("QSYS", "QSYS2", "QTEMP", "SESSION", "SYSIBM", "QUSRSYS", "QUSRBRM")

#: A table of static schemas with up to so many names is given to every task.
MOST_STATIC = 10_000
Static = Sequence[str] | DataFrame

_STATEMENT = "statement_number"


def _computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is evaluated once per row.

    A filter on a plain computed column is pushed beneath its projection, which
    evaluates the expression a second time; it is not pushed beneath a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_references(statements: DataFrame, name: str = "references") -> DataFrame:
    """Statements with an array of the table references in their text."""
    masked, text = F.col("_masked"), F.col("statement_text")
    # The steps of ``reference_array``, each a column: within one another they would be slower.
    found = _computed_once(statements, "_masked", mask_text(text))
    found = _computed_once(found, "_segments", segment_array(masked))
    found = _computed_once(found, "_marked", marked_text(masked, F.col("_segments"))).drop("_segments")
    found = _computed_once(found, "_pieces", reference_pieces(F.col("_marked"))).drop("_marked")
    found = _computed_once(found, "_spans", piece_spans(masked, F.col("_pieces"))).drop("_pieces")
    return _computed_once(found, name, span_references(masked, text, F.col("_spans"))).drop("_masked", "_spans")


def table_references(statements: DataFrame) -> DataFrame:
    """One row per table reference, numbered in text order within its statement."""
    found = with_references(statements).select(_STATEMENT, "statement_text", F.posexplode("references").alias("_i", "_r"))
    return found.select(
        (F.col("_i") + 1).alias("seq"),
        F.lit("TABLE").alias("name_type"),
        F.col("_r.name").alias("name"),
        F.col("_r.schema").alias("schema"),
        F.lit(None).cast("string").alias("column_name"),
        F.col("_r.name_start_position").alias("name_start_position"),
        _STATEMENT,
        "statement_text",
    )


def _static_names(static: Static) -> list[str | None] | None:
    """The static schemas as a list; None for a table of more than MOST_STATIC names."""
    if not isinstance(static, DataFrame):
        return list(static)
    found = static.select(F.rtrim(F.col(static.columns[0]).cast("string")).alias("name")).distinct().limit(MOST_STATIC + 1)
    names = [row.name for row in found.collect()]
    return names if len(names) <= MOST_STATIC else None


def _is_in(schema: Column, names: list[str | None]) -> Column:
    """IN as SQL has it: unknown where the schema is null, or not found next to a null."""
    return schema.isin(names) if names else F.lit(False) & schema.isNotNull()


def _mark_static(references: DataFrame, static: Static) -> DataFrame:
    """Rows with a ``schema`` and whether it is static: true, false, or unknown as with IN.

    A list, or a table up to MOST_STATIC names, becomes a literal. A larger table is joined:
    each different schema once, then the references by schema, without a shuffle for those
    that many references share.
    """
    names = _static_names(static)
    if names is not None:
        return references.withColumn("_static", _is_in(F.col("schema"), names))
    library = static.select(F.rtrim(F.col(static.columns[0]).cast("string")).alias("schema"))
    unknown = library.where(F.col("schema").isNull()).limit(1).count() > 0
    references = settle(references)
    used = references.where(F.col("schema").isNotNull()).groupBy("schema").agg(F.count("*").alias("_n"))
    known = library.distinct().withColumn("_static", F.lit(True))
    missing = F.lit(None).cast("boolean") if unknown else F.lit(False)
    facts = settle(used.join(known, "schema", "left").withColumn("_static", F.coalesce("_static", missing)))
    bare = references.where(F.col("schema").isNull()).withColumn("_static", F.lit(None).cast("boolean"))
    return weighted_lookup(references, facts, ["schema"], "_n").unionByName(bare)


def _needs_strip(schema: Column, is_static: Column) -> Column:
    """Qualified, and not in the static schemas; not where that is unknown."""
    return schema.isNotNull() & F.coalesce(~is_static, F.lit(False))


def _clean(schema: Column, is_static: Column) -> Column:
    return schema.isNull() | F.coalesce(is_static, F.lit(False))


def strip_references(
    references: DataFrame,
    guarded: bool = True,
    mode: str = "skip",
    static: Static = STATIC_SCHEMAS,
    keep_static: bool = False,
    whole_word: bool = False,
    statements: DataFrame | None = None,
) -> DataFrame:
    """Statement texts without schemas, from rows of ``table_references``.

    For each reference in turn the first occurrence of its schema goes.
    ``guarded`` takes only statements with a qualified, non-static reference and
    accepts ``.``, ``|`` or ``/`` with blanks as the separator; otherwise all
    statements, and the dot. ``mode`` (see ``strip_chain``): ``"stop"`` with the
    guard and ``"null"`` without are the strict chains. A statement without
    reference 1 gives nothing, and its chain ends at a gap in the numbers.

    ``static`` is a list or a table of schemas; next to a null in the table no schema
    is known not to be static, as with NOT IN. With ``statements`` the texts are joined
    by number after the references are folded; without, they come from the references.
    A group is the references of one statement, bounded by its own text; only number
    and schema of each are collected.
    """
    narrow = references.select(_STATEMENT, "seq", "schema", *([] if statements is not None else ["statement_text"]))
    refs = F.sort_array(F.collect_list(F.struct("seq", "schema", "_static"))).alias("_refs")
    texts = [] if statements is not None else [F.any_value("statement_text").alias("original_statement")]
    grouped = _mark_static(narrow, static).groupBy(_STATEMENT).agg(refs, *texts)
    if guarded:
        grouped = grouped.where(F.exists("_refs", lambda r: _needs_strip(r["schema"], r["_static"])))
    chained = grouped.withColumn("_refs", F.filter("_refs", lambda r, i: r["seq"] == i + 1)).where(F.size("_refs") > 0)
    if statements is not None:
        chained = chained.join(statements.select(_STATEMENT, F.col("statement_text").alias("original_statement")), _STATEMENT)
    return _finish(chained, guarded, mode, keep_static, whole_word)


def strip_statements(
    statements: DataFrame,
    guarded: bool = True,
    mode: str = "skip",
    static: Static = STATIC_SCHEMAS,
    keep_static: bool = False,
    whole_word: bool = False,
) -> DataFrame:
    """``strip_references`` straight from the texts (statement numbers are unique); scan,
    find and strip stay in one stage without an exchange. A table of static schemas too
    large for a literal is looked up by schema, and the texts are joined by number."""
    names = _static_names(static)
    if names is None:
        found = table_references(statements).drop("statement_text")
        return strip_references(found, guarded, mode, static, keep_static, whole_word, statements)
    refs = F.transform("references", lambda r: F.struct(r["schema"].alias("schema"), _is_in(r["schema"], names).alias("_static")))
    found = with_references(statements).select(_STATEMENT, F.col("statement_text").alias("original_statement"), refs.alias("_refs"))
    wanted = F.exists("_refs", lambda r: _needs_strip(r["schema"], r["_static"])) if guarded else F.size("_refs") > 0
    return _finish(found.where(wanted), guarded, mode, keep_static, whole_word)


def _finish(found: DataFrame, guarded: bool, mode: str, keep_static: bool, whole_word: bool) -> DataFrame:
    separator = GUARDED_SEPARATOR if guarded else SIMPLE_SEPARATOR
    schemas = F.transform("_refs", lambda r: r["schema"])
    keep = F.transform(F.filter("_refs", lambda r: r["_static"]), lambda r: r["schema"]) if keep_static else None
    text = strip_chain(F.col("original_statement"), schemas, mode, separator, keep, whole_word)
    return _computed_once(found, "statement_text_parsed", text).select(
        _STATEMENT, "statement_text_parsed", "original_statement"
    )


def strip_audit(references: DataFrame, dirty: bool, static: Static = STATIC_SCHEMAS) -> DataFrame:
    """Reference rows and statements of the statements with at least one
    reference to strip (``dirty``) or one that needs none; a statement can be both.

    Counted per statement first: one exchange of counters, no join of the
    references with themselves. ``static`` as in ``strip_references``.
    """
    wanted = _needs_strip if dirty else _clean
    marked = _mark_static(references.select(_STATEMENT, "schema"), static)
    per_statement = marked.groupBy(_STATEMENT).agg(
        F.count("*").alias("_rows"),
        F.bool_or(wanted(F.col("schema"), F.col("_static"))).alias("_wanted"),
    )
    return per_statement.where("_wanted").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("reference_rows"),
        F.count(_STATEMENT).alias("statements"),
    )


def audit_statements(statements: DataFrame, static: Static = STATIC_SCHEMAS) -> DataFrame:
    """Both audits of ``strip_audit`` in one pass over the texts: a row "clean" and a row
    "dirty"; only counters are shuffled (and references, for a large table of schemas)."""
    kinds = {"clean": _clean, "dirty": _needs_strip}
    names = _static_names(static)
    if names is None:
        narrow = settle(table_references(statements).select(_STATEMENT, "schema"))
        audits = [strip_audit(narrow, kind == "dirty", static).select(F.lit(kind).alias("audit"), "*") for kind in kinds]
        return audits[0].unionByName(audits[1])

    def any_reference(wanted) -> Column:
        return F.exists("references", lambda r: wanted(r["schema"], _is_in(r["schema"], names)))

    found = with_references(statements).select(
        F.size("references").cast("bigint").alias("_rows"),
        *[any_reference(wanted).alias(kind) for kind, wanted in kinds.items()],
    )
    counted = found.agg(
        *[
            F.struct(
                F.lit(k).alias("audit"),
                F.coalesce(F.sum(F.when(F.col(k), F.col("_rows"))), F.lit(0)).alias("reference_rows"),
                F.count_if(F.col(k)).alias("statements"),
            ).alias(k)
            for k in kinds
        ]
    )
    return counted.select(F.inline(F.array(*kinds)))


def table_sizes(df: DataFrame) -> DataFrame:
    """Rows and distinct statements of a table of references or texts."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(_STATEMENT).alias("statements"))


def fingerprint_counts(stripped: DataFrame) -> DataFrame:
    """How many different stripped texts there are, and how many statements."""
    return (
        stripped.select(_fingerprint())
        .groupBy("_print")
        .agg(F.count("*").alias("_n"))
        .agg(
            F.count("_print").alias("distinct_statements"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("statements"),
        )
    )


def statement_xref(stripped: DataFrame) -> DataFrame:
    """Every statement with the greatest statement number of the same stripped text.

    Texts are compared by their SHA-256, so no text is shuffled. Each text shrinks
    to one row on the map side before the exchange; a text that many statements
    share is then looked up without shuffling them (see ``weighted_lookup``). Null
    texts match nothing.
    """
    printed = settle(stripped.select(_STATEMENT, _fingerprint()).where(F.col("_print").isNotNull()))
    latest = settle(printed.groupBy("_print").agg(F.max(_STATEMENT).alias("_latest"), F.count("*").alias("_rows")))
    return weighted_lookup(printed, latest, ["_print"], "_rows").select(
        F.col("_latest").alias(_STATEMENT),
        F.col(_STATEMENT).alias("related_statement_number"),
    )


def _fingerprint() -> Column:
    return F.unhex(F.sha2(F.col("statement_text_parsed"), 256)).alias("_print")
