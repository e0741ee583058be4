"""Statement records of a query monitor or plan-cache dump."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.arrays import let
from opsframe.functions.scalars import job_id

STATEMENT_RECORD = 1000

# Raw monitor column, its meaning in a statement record, its type.
STATEMENT_COLUMNS = tuple(
    tuple(line.split())
    for line in """
    qqrid row_id bigint
    qqtime time_created timestamp
    qqjfld join_column string
    qqrdbn relational_database_name string
    qqsys system_name string
    qqjob job_name string
    qquser job_user string
    qqjnum job_number string
    qqi9 thread_id bigint
    qqucnt unique_count bigint
    qqi5 unique_refresh_counter bigint
    qqudef user_defined string
    qqstn statement_number bigint
    qqc11 statement_function string
    qqc21 statement_operation string
    qqc12 statement_type string
    qqc13 parse_required string
    qqc103 package_name string
    qqc104 package_library string
    qqc181 cursor_name string
    qqc182 statement_name string
    qqstim start_timestamp timestamp
    qq1000 statement_text string
    qqc14 statement_outcome string
    qqi2 result_rows bigint
    qqc22 dynamic_replan_reason_code string
    qqc16 data_conversion_reason_code string
    qqi4 total_time_milliseconds bigint
    qqi3 rows_fetched bigint
    qqetim end_timestamp timestamp
    qqi6 total_time_microseconds bigint
    qqi7 sql_statement_length bigint
    qqi1 insert_unique_count bigint
    qqi8 sqlcode bigint
    qqc81 sqlstate string
    qvc101 close_cursor_mode string
    qvc11 allow_copy_data_value string
    qvc12 pseudoopen string
    qvc13 pseudoclose string
    qvc14 odp_implementation string
    qvc21 dynamic_replan_subcode string
    qvc41 commitment_control_level string
    qwc1b concurrent_access_resolution string
    qvc15 blocking_type string
    qvc16 delay_prepare string
    qvc1c explainable string
    qvc17 naming_convention string
    qvc18 dynamic_processing_type string
    qvc19 lob_data_optimized string
    qvc1a program_user_profile_used string
    qvc1b dynamic_user_profile_used string
    qvc1281 default_collection string
    qvc1282 procedure_name string
    qvc1283 procedure_library string
    qqclob2 sql_path string
    qvc1284 current_schema string
    qqc18 binding_type string
    qqc61 cursor_type string
    qvc1d statement_originator string
    qqc15 hard_close_reason_code string
    qqc23 hard_close_subcode string
    qvc42 date_format string
    qwc11 date_separator string
    qvc43 time_format string
    qwc12 time_separator string
    qwc13 decimal_point string
    qvc104 sort_sequence_table string
    qvc105 sort_sequence_library string
    qvc44 language_id string
    qvc23 country_id string
    qqia first_n_rows_value bigint
    qqf1 optimize_for_n_rows_value double
    qvc22 sql_access_plan_reason_code string
    qvc24 access_plan_not_saved_reason_code string
    qvc81 transaction_context_id string
    qvp152 activation_group_mark bigint
    qvp153 open_cursor_threshold bigint
    qvp154 open_cursor_close_count bigint
    qvp155 commitment_control_lock_limit bigint
    qwc15 allow_sql_mixed_constants string
    qwc16 suppress_sql_warnings string
    qwc17 translate_ascii string
    qwc18 system_wide_statement_cache string
    qvp159 lob_locator_threshold bigint
    qvp156 max_decimal_precision bigint
    qvp157 max_decimal_scale bigint
    qvp158 min_decimal_divide_scale bigint
    qwc19 unicode_normalization string
    qq1000l statement_text_long string
    qvp15b old_access_plan_length bigint
    qvp15c new_access_plan_length bigint
    qvp151 fast_delete_count bigint
    qqf2 statement_max_compression double
    qvc102 current_user_profile string
    qvc1e expression_evaluator_used string
    qvp15a host_server_delta bigint
    qqc301 nts_lock_space_id string
    qqc183 ip_address string
    qfc11 ip_type string
    qqsmint2 ip_port_number bigint
    qvc3004 nts_transaction_id string
    qqsmint3 nts_format_id_length bigint
    qqsmint4 nts_transatction_id_sublength bigint
    qvrcnt unique_refresh_counter2 bigint
    qvp15f times_run bigint
    qvp15e fullopens bigint
    qvc1f proc_in_cache string
    qwc1a combined_operation string
    qvc3001 client_applname string
    qvc3002 client_userid string
    qvc3003 client_wrkstnname string
    qvc3005 client_acctng string
    qvc3006 client_progamid string
    qvc5001 interface_information string
    qvc82 open_options string
    qwc1d extended_indicators string
    qwc1c decfloat_rounding_mode string
    qwc1e sql_decfloat_warnings string
    qvp15d worst_time_micro bigint
    qqint05 sq_unique_count bigint
    qfc13 concurrent_access_res_used string
    qqsmint8 sql_scalar_udfs_not_inlined bigint
    qvc3007 result_set_cursor string
    qfc12 implicit_xmlparse_option string
    qqsmint7 sql_xml_data_ccsid bigint
    qqsmint5 optimizer_use bigint
    qfc14 xml_schema_in_cache string
    """.strip().splitlines()
)

# What identifies a plan, and how the other columns roll up.
ROLLUP_KEYS = (
    "system_name",
    "cursor_name",
    "statement_name",
    "package_library",
    "parse_required",
    "procedure_name",
    "procedure_library",
    "statement_function",
    "sqlcode",
    "sqlstate",
    "statement_text",
    "allow_copy_data_value",
    "first_n_rows_value",
    "commitment_control_level",
    "statement_operation",
    "statement_outcome",
    "data_conversion_reason_code",
    "optimize_for_n_rows_value",
    "pseudoopen",
    "odp_implementation",
    "sql_access_plan_reason_code",
    "access_plan_not_saved_reason_code",
    "hard_close_reason_code",
    "hard_close_subcode",
    "dynamic_replan_reason_code",
    "dynamic_replan_subcode",
    "open_options",
    "system_wide_statement_cache",
)
ROLLUP_SUMS = ("total_time_microseconds", "fullopens", "times_run", "result_rows", "rows_fetched")
ROLLUP_MAXIMA = (
    "current_user_profile",
    "statement_number",
    "statement_text_long",
    "worst_time_micro",
    "start_timestamp",
    "end_timestamp",
    "ip_address",
    "old_access_plan_length",
    "new_access_plan_length",
)


def decode_statements(monitor: DataFrame) -> DataFrame:
    """Statement records with their generic columns under the names of their meaning."""
    return monitor.where(F.col("qqrid") == STATEMENT_RECORD).select(
        *[F.col(raw).alias(name) for raw, name, _ in STATEMENT_COLUMNS]
    )


def plan_rollup(
    statements: DataFrame,
    keys: Sequence[str] = ROLLUP_KEYS,
    sums: Sequence[str] = ROLLUP_SUMS,
    maxima: Sequence[str] = ROLLUP_MAXIMA,
) -> DataFrame:
    """One row per plan: times, opens, runs and rows summed, the latest of the rest.

    Text maxima make Spark aggregate by sorting. The digest in front of the keys
    lets that sort compare one long instead of some thirty columns.
    """
    job = job_id(F.col("job_number"), F.col("job_user"), F.col("job_name"))
    rolled = statements.groupBy(F.xxhash64(*keys).alias("_digest"), *keys).agg(
        F.to_date(F.max("end_timestamp")).alias("extract_date"),
        F.max(job).alias("job"),
        *[F.max(c).alias(c) for c in maxima],
        *[F.sum(c).alias(c) for c in sums],
    )
    return rolled.select(*keys, "extract_date", "job", *maxima, *sums)


def search_statements(statements: DataFrame, text: str, column: str = "statement_text") -> DataFrame:
    """Statements that contain ``text``, ignoring case."""
    return statements.where(F.upper(column).contains(text.upper()))


def trigram_postings(statements: DataFrame, number: str = "statement_number", column: str = "statement_text", *keep: str) -> DataFrame:
    """(trigram, number, and the columns of ``keep``): which statements hold which three characters.

    Characters are in upper case, as ``search_statements`` compares them. Written by
    capture date and sorted by trigram, a search reads its own trigrams only. Texts of
    fewer than three characters and null have none.
    """
    text = F.upper(column)

    def three(chars: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(chars) - 3)
        return F.transform(places, lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))

    rows = statements.select(number, *keep, F.when(F.length(text) >= 3, F.array_distinct(let(F.split(text, ""), three))).alias("_t"))
    return rows.select(F.explode("_t").alias("trigram"), number, *keep)


def search_indexed(
    statements: DataFrame, postings: DataFrame, text: str, number: str = "statement_number", column: str = "statement_text"
) -> DataFrame:
    """``search_statements`` by way of ``trigram_postings``: only statements that hold every
    trigram of ``text`` are read and compared. A text of fewer than three characters has
    no trigram, and all statements are compared."""
    wanted = text.upper()
    needed = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    if not needed:
        return search_statements(statements, text, column)
    hits = postings.where(F.col("trigram").isin(needed)).groupBy(number).agg(F.count_distinct("trigram").alias("_n"))
    numbers = hits.where(F.col("_n") == len(needed)).select(number)
    return search_statements(statements.join(numbers, number, "left_semi"), text, column)


def snapshot_counts(statements: DataFrame, rollup: DataFrame) -> DataFrame:
    """How many statement records there are, and how many plans they roll up to."""
    counted = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("level"), "rows")
        for name, df in (("statements", statements), ("plans", rollup))
    ]
    return counted[0].unionByName(counted[1])
