"""Operational tables derived from the given ones.

The operational tables themselves are not among the test data, so each is
derived from the table nearest to it. The texts keep to SQL that means the same
to Spark and to DuckDB; both sides of a proof read the very same input, and only
the job itself is written twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from opsframe.operators.intervals import SYSTEM_COUNTERS
from opsframe.operators.monitor import STATEMENT_COLUMNS
from opsframe.sources.tables import read_tables

SOURCE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def _text(value: str, width: int = 0) -> str:
    text = f"cast({value} as string)"
    return f"lpad({text}, {width}, '0')" if width else text


def _stamp12(ts: str) -> str:
    fields = [f"year({ts}) % 100", *[f"{part}({ts})" for part in ("month", "day", "hour", "minute")]]
    seconds = f"cast(floor(second({ts})) as int)"
    return " || ".join(_text(field, 2) for field in [*fields, seconds])


_HOUR = "((year(ts) * 12 + month(ts)) * 31 + day(ts)) * 24 + hour(ts)"
_CENTS = "cast(round(value * 100) as bigint)"

ERRORS = f"""
select ts as failtime, event_type as failrsn,
  'GRP' || {_text('user_id % 3')} as dbgroup, 'LIB' || {_text('user_id % 4')} as applib,
  'APP' || {_text('user_id % 5')} as appname,
  case when user_id % 2 = 0 then 'PGM' else 'SRVPGM' end as apptype,
  case when user_id % 19 = 0 then null else 'JOB' || {_text('user_id')} end as jobname,
  props || repeat('-', 195) || event_type as msgs
from {{events}}"""

COLLECTIONS = f"""
select case when o_orderstatus = 'P' then '*PFR' else '*CS' end as ccclrid,
  'Q' || {_text('o_orderkey', 9)} as cccnname, o_orderdate as ccstrdt,
  case when o_orderkey % 50 = 0 then null else o_orderdate + interval '2' day end as ccenddt
from {{orders}}"""

# Moments in the years that the collections are of.
TIMES = """
select ts - interval '26' year as asked_at from {events}"""

TABLE_MEMBERS = f"""
select case when l_returnflag = 'N' then 'OTHER' else 'QMPGDATA' end as system_table_schema,
  case l_linenumber when 1 then 'QAPMSMCMN' when 2 then 'QAPMSMDSK' when 3 then 'QAPMSMJMI' when 4 then 'QAPMSMJOS'
    when 5 then 'QAPMSMPOL' when 6 then 'QAPMOTHER' else 'QAPMJOBMI' end as system_table_name,
  'Q' || {_text('l_orderkey', 9)} as system_table_member
from {{lineitem}}"""

SAMPLES = """
select l_returnflag as collection_id, l_orderkey as intnum, l_shipdate as dtetim, l_quantity as value
from {lineitem}"""

JOB_SAMPLES = f"""
select {_HOUR} as intnum, min(ts) as datetime,
  case when event_type = 'view' then 1 else 2 end as smmbdd,
  cast(sum({_CENTS} % 40) as double) / 4 as smmtcpup, count(*) as smmnum,
  {_text('max(user_id)', 6)} as smmmcnbr, 'USER' || {_text('min(user_id)')} || '  ' as smmmcuser, 'QPADEV' as smmmcname
from {{events}} where event_type in ('view', 'click')
group by {_HOUR}, case when event_type = 'view' then 1 else 2 end"""

OS_SAMPLES = f"""
select {_HOUR} as intnum, (sum({_CENTS}) % 12) * 255 as smoarspt, max({_CENTS}) * 5 as smomrspt,
  cast(count(*) as double) / 4 as smoitrnr, cast(sum(user_id) as double) / 2 as smoblior,
  cast(count(distinct user_id) as double) / 8 as smosplfr,
  {_text('max(user_id)', 6)} as smomrnbr, 'USER' || {_text('max(user_id)')} as smomruser, 'QPRTJOB' as smomrname
from {{events}} group by {_HOUR}"""

POOL_SAMPLES = f"""
select {_HOUR} as intnum, cast(max(user_id) as double) / 8 as smpmfltr, cast(min(user_id) as double) / 16 as smpuafltr,
  cast(sum(user_id) as double) / 32 as smpumfltr, max(user_id) % 64 as smpumfltp
from {{events}} group by {_HOUR}"""

SYSTEM_SAMPLES = f"""
select {_HOUR} as intnum, cast(sum({_CENTS} % 100) as double) / 8 as smscpucpu,
  cast(sum({_CENTS} % 50) as double) / 8 as smscpuqpu, sum({_CENTS}) as smsctstgu
from {{events}} group by {_HOUR}"""

INTERVAL_COUNTERS = """
select l_orderkey as intnum, l_shipdate as datetime, l_linenumber as sitype,
  case when l_returnflag = 'A' then 1 else 2 end as sidid,
  cast(floor(l_quantity) as bigint) - 1 as sidata01, cast(floor(l_extendedprice) as bigint) as sidata02
from {lineitem}"""

# Every counter has values of its own.
_COUNTERS = ", ".join(f"s_suppkey * {place + 1} + s_nationkey as {name}" for place, name in enumerate(SYSTEM_COUNTERS))
SUPPLIER_METRICS = f"""
select s_suppkey as intnum, s_name as dtetim, {_COUNTERS} from {{supplier}}"""

SESSION_SAMPLES = f"""
select 'QPADEV' || {_text('user_id % 10', 4)} as jbname, 'USER' || {_text('user_id % 7')} || '  ' as jbuser,
  {_text('user_id', 6)} as jbnbr, case when event_type = 'error' then 'B' else 'I' end as jbtype,
  case when user_id % 9 = 8 then null else user_id % 4 end as jbstsf,
  {_stamp12('ts')} as dtetim, {_CENTS} % 13 as jbtcpu
from {{events}}"""

ALLOWLIST = f"""
select 'PROF' || {_text('c_custkey % 20')} || '  ' as profile, '10.0.0.' || {_text('c_custkey % 50')} as ip_address,
  cast((c_custkey % 7) * 5000 as decimal(5, 0)) as allowed_query_min,
  case c_nationkey % 3 when 0 then 'Y' when 1 then 'N' else null end as hard_limit
from {{customer}}"""

ACTIVE_JOBS = f"""
select distinct {_text('user_id', 6)} || '/QUSER/QZDASOINIT' as job_name, user_id * 31 as cpu_time,
  cast(user_id % 50 as int) as run_priority, 'PROF' || {_text('user_id % 20')} || '  ' as authorization_name,
  case when user_id % 13 = 0 then 'SYS' else 'BCH' end as job_type
from {{events}}"""

JOB_STATEMENTS = f"""
select {_text('user_id', 6)} || '/QUSER/QZDASOINIT' as job_name,
  case when event_type = 'purchase' then 'COMPLETE' else 'ACTIVE' end as v_sql_stmt_status,
  ts as v_sql_stmt_start_timestamp, 'select ' || props as v_sql_statement_text,
  case when user_id % 11 = 0 then null else '10.0.0.' || {_text('user_id % 50')} end as v_client_ip_address,
  'WS' || {_text('user_id % 5')} as v_client_wrkstnname, 'APP' || {_text('user_id % 6')} as v_client_applname,
  'PGM' || {_text('user_id % 4')} as v_client_programid, 'U' || {_text('user_id')} as v_client_userid,
  'QGPL' as v_query_options_lib_name
from {{events}}"""

JOB_SNAPSHOT = f"""
select {_text('o_orderkey', 6)} || '/' || c_mktsegment || '/' || c_name as job_name,
  case o_orderstatus when 'O' then '*ACTIVE' when 'P' then '*JOBQ' else '*OUTQ' end as status,
  case when o_custkey % 2 = 0 then '*BATCH' else '*INTERACT' end as job_type, c_mktsegment as job_user,
  'SBS' || {_text('c_nationkey % 3')} as subsystem, '*JOB' as submitter,
  case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then 'ABNORMAL' else 'NORMAL' end as completion_status
from {{orders}} join {{customer}} on o_custkey = c_custkey"""

_Q1 = f"case when o_orderkey % 5 = 0 then '' else 'LIB' || {_text('o_orderkey % 3')} || case when o_orderkey % 2 = 0 then '.' else ' / ' end end"
_Q2 = f"case when o_custkey % 4 = 0 then '' else 'lib' || {_text('o_custkey % 3')} || '.' end"
_Q3 = "case when o_orderkey % 3 = 0 then '' else 'QSYS2.' end"
_T1, _T2 = f"'ORD' || {_text('o_orderkey % 7')}", "'CUST'"

# Fixed-width names, as the table of libraries keeps them.
STATIC_LIBRARIES = """
select rpad(case when n_nationkey % 5 = 0 then 'QSYS2' when n_nationkey % 5 = 1 then 'LIB0'
  else 'LIB' || cast(n_nationkey as string) end, 10, ' ') as library
from {nation} where n_nationkey not in (2, 3)"""

STATEMENTS = f"""
select o_orderkey as statement_number,
  'Select a.* from ' || {_Q1} || {_T1} || ' a, ' || {_Q2} || {_T2} || ' b join ' || {_Q3} || 'NOTES c on a.id = b.id'
    || ' where c.note <> ''from HIDDEN.T1'' -- join HIDDEN.T2' || chr(10) || ' and b.status = ''' || o_orderstatus
    || ''' /* into HIDDEN.T3 */ order by 1' as statement_text
from {{orders}}"""

# The same references as the texts above hold, worked out from their parts.
REFERENCES = f"""
select 1 as seq, 'ORD' || {_text('o_orderkey % 7')} as name,
  case when o_orderkey % 5 = 0 then null else 'LIB' || {_text('o_orderkey % 3')} end as schema,
  17 as name_start_position, o_orderkey as statement_number from {{orders}}
union all
select 2, 'CUST', case when o_custkey % 4 = 0 then null else 'LIB' || {_text('o_custkey % 3')} end,
  17 + length({_Q1} || {_T1} || ' a, '), o_orderkey from {{orders}}
union all
select 3, 'NOTES', case when o_orderkey % 3 = 0 then null else 'QSYS2' end,
  17 + length({_Q1} || {_T1} || ' a, ' || {_Q2} || {_T2} || ' b join '), o_orderkey from {{orders}}"""

DOCUMENT_STATEMENTS = """
select doc_id as statement_number,
  'insert into ARCHIVE.' || source || ' select ''' || replace(text, '''', '''''') || ''' from STAGE/INBOX' as statement_text
from {documents}"""

REGEX_CASES = """
select 'Insert into FOO/' || s_name as statement_text, 'FOO' as schema, 1 as form from {supplier}
union all select 'Insert into FOO.' || s_name, 'foo', 2 from {supplier}
union all select 'INSERT INTO FOO / ' || s_name, 'FOO', 3 from {supplier}
union all select 'INSERT INTO FOO . ' || s_name, 'foo', 4 from {supplier}"""

MONTHS = """
select l_orderkey * 8 + l_linenumber as rid, l_linestatus as mo, cast(l_orderkey % 255 as smallint) as dtanbr,
  l_returnflag || l_linestatus as dtachr, l_shipdate as chgtsp
from {lineitem}"""

# What the derived monitor holds; each other column has two values of its own.
_MONITOR = {
    "qqrid": """cast(case when l_linenumber <= 2 then 1000 when l_linenumber = 3 then 3014 when l_linenumber = 4 then 3019
      when l_linenumber = 5 then 3020 when l_linenumber = 6 then 3010 when l_returnflag = 'A' then 3015
      when l_returnflag = 'N' then 3006 else 3018 end as bigint)""",
    "qqtime": "l_shipdate",
    "qqjfld": f"'K' || {_text('o_orderkey', 9)}",
    "qqrdbn": f"'RDB' || {_text('o_custkey % 2')}",
    "qqsys": f"'SYS' || {_text('o_custkey % 3')}",
    "qqjob": "case when o_custkey % 3 = 0 then 'QZDASOINIT' else 'QSQSRVR' end",
    "qquser": "case when o_custkey % 2 = 0 then 'QUSER     ' else 'BATCH     ' end",
    "qqjnum": _text("o_custkey % 100", 6),
    "qqi9": "l_suppkey",
    "qqucnt": "o_custkey % 300",
    "qqi5": "case when l_linenumber in (3, 4) then l_partkey * 37 else l_partkey % 3 end",
    "qqudef": f"'UDF' || {_text('l_suppkey % 4')}",
    "qqstn": "o_orderkey * 8 + l_linenumber",
    "qqc11": "case when l_partkey % 2 = 0 then 'S' else 'U' end",
    "qqc21": """case l_partkey % 8 when 0 then 'OP' when 1 then 'FE' when 2 then 'CL' when 3 then 'UP' when 4 then 'DL'
      when 5 then 'IN' when 6 then 'SV' else 'XX' end""",
    "qqc12": "case when l_partkey % 3 = 0 then 'D' else 'S' end",
    "qqc13": "case when l_partkey % 5 = 0 then 'Y' else 'N' end",
    "qqc103": f"'PKG' || {_text('l_suppkey % 6')}",
    "qqc104": f"'PKGLIB' || {_text('l_suppkey % 2')}",
    "qqc181": "case when l_suppkey % 2 = 0 then ' ' else 'C1' end",
    "qqc182": f"'STMT' || {_text('l_partkey % 4')}",
    "qqstim": "case when l_partkey % 23 = 0 then null else o_orderdate end",
    "qq1000": "case when l_discount = 0 then null else 'select ' || l_returnflag end",
    "qqi2": "cast(floor(l_quantity) as bigint) - 10",
    "qqi4": "l_partkey % 1000",
    "qqi3": "case when l_partkey % 5 = 0 then null else cast(floor(l_quantity) as bigint) end",
    "qqetim": "case when l_partkey % 17 = 0 then null else l_shipdate end",
    "qqi6": "cast(floor(l_extendedprice) as bigint)",
    "qqi7": "l_partkey % 7000",
    "qqi1": "l_partkey * 11",
    "qqi8": "cast(case when l_linestatus = 'F' then 0 else -100 end as bigint)",
    "qqc81": "case when l_linestatus = 'F' then '00000' else '02000' end",
    "qvc11": "case when l_suppkey % 2 = 0 then 'Y' else 'O' end",
    "qvc12": "case when l_suppkey % 3 = 0 then 'Y' else 'N' end",
    "qvc1c": "case when l_returnflag = 'A' then 'Y' else 'N' end",
    "qvc1282": f"'PROC' || {_text('o_custkey % 3')}",
    "qqia": "o_custkey % 2",
    "qqf1": "cast(l_partkey % 2 as double) + 0.5",
    "qvc24": "case l_partkey % 4 when 0 then 'AB' when 1 then 'A1' when 2 then 'B3' else null end",
    "qq1000l": f"""case when l_tax < 0.005 then null when l_tax < 0.015 then ''
      else 'select ' || o_orderpriority || ' from LIB' || {_text('o_custkey % 3')} || '.ORD' end""",
    "qvp15b": "l_partkey * 3",
    "qvp15c": "l_partkey * 4",
    "qvp151": "l_suppkey * 5",
    "qvc102": f"'USR' || {_text('o_custkey % 10')}",
    "qqc183": f"'10.1.0.' || {_text('l_suppkey % 200')}",
    "qvrcnt": "l_partkey % 3 - 1",
    "qvp15f": "case when l_partkey % 4 = 0 then null else l_partkey % 3 end",
    "qvp15e": "l_partkey % 6",
    "qvp15d": "case when l_partkey % 3 = 0 then null else cast(floor(l_extendedprice) as bigint) * 2 end",
    "qqsmintf": "cast(case when l_suppkey % 3 = 0 then null else l_suppkey % 3 end as int)",
    "qxc16": "case when l_suppkey % 2 = 0 then '1' else '0' end",
    "qqint03": "l_suppkey % 40",
    "qqc83": "substr(md5(cast(l_partkey as string)), 1, 8)",
    "qqdbclob1": "case when l_partkey % 6 = 0 then 'x' else null end",
    "qqtfn": f"case when l_linenumber = 5 then 'FILE' || {_text('l_partkey % 30')} else null end",
    "qvqtbl": f"case when l_linenumber = 5 then 'file_' || {_text('l_partkey % 30')} else null end",
    "qvptbl": f"'pfile_' || {_text('l_suppkey % 30')}",
    "qqptfn": f"'PF' || {_text('l_suppkey % 30')}",
    "qqrcod": "case l_partkey % 5 when 0 then 'A1' when 1 then 'A4' when 2 then 'B6' when 3 then 'AF' else 'AB' end",
    "qqc101": f"'MON' || {_text('l_suppkey % 3')}",
}
_MONITOR_TYPES = {raw: kind for raw, _, kind in STATEMENT_COLUMNS}


def _own_value(column: str, place: int) -> str:
    if _MONITOR_TYPES[column] == "string":
        return f"'{column}_' || {_text('l_partkey % 2')}"
    return f"cast({1000 * place} + l_partkey % 2 as {_MONITOR_TYPES[column]})"


MONITOR = "\nselect {}\nfrom {{lineitem}} join {{orders}} on l_orderkey = o_orderkey".format(
    ",\n  ".join(
        f"{_MONITOR.get(column) or _own_value(column, place)} as {column}"
        for place, column in enumerate(dict.fromkeys([*_MONITOR_TYPES, *_MONITOR]))
    )
)

BINDINGS = {
    "errors": ERRORS,
    "collections": COLLECTIONS,
    "times": TIMES,
    "table_members": TABLE_MEMBERS,
    "samples": SAMPLES,
    "job_samples": JOB_SAMPLES,
    "os_samples": OS_SAMPLES,
    "pool_samples": POOL_SAMPLES,
    "system_samples": SYSTEM_SAMPLES,
    "interval_counters": INTERVAL_COUNTERS,
    "supplier_metrics": SUPPLIER_METRICS,
    "session_samples": SESSION_SAMPLES,
    "allowlist": ALLOWLIST,
    "active_jobs": ACTIVE_JOBS,
    "job_statements": JOB_STATEMENTS,
    "job_snapshot": JOB_SNAPSHOT,
    "static_libraries": STATIC_LIBRARIES,
    "statements": STATEMENTS,
    "refs": REFERENCES,
    "document_statements": DOCUMENT_STATEMENTS,
    "regex_cases": REGEX_CASES,
    "months": MONTHS,
    "monitor": MONITOR,
}


def derived(spark: SparkSession, folder: str, name: str, even: bool = False) -> DataFrame:
    """A derived operational table as a DataFrame. With ``even`` the rows it is made of are dealt
    to some tasks for each core first: work on its texts is then not bound to the row groups of the files."""
    text = BINDINGS[name]
    tables = read_tables(spark, folder, *sorted(set(re.findall(r"\{(\w+)\}", text))))
    if even:
        tasks = 4 * spark.sparkContext.defaultParallelism
        tables = {table: df.repartition(tasks) for table, df in tables.items()}
    return spark.sql(text, **tables)


def with_clause(*names: str) -> str:
    """The derived tables as a WITH clause over the given tables."""
    plain = {table: table for table in SOURCE_TABLES}
    return "with recursive " + ",\n".join(f"{name} as ({BINDINGS[name].format(**plain)})" for name in names)
