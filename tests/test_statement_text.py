from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsframe.functions.arrays import states
from opsframe.functions.statement_text import mask_text, reference_array, remove_first, strip_chain
from opsframe.operators import statements as job
from tests.plans import planned


def one(spark, text, schema=None):
    return spark.createDataFrame([(text, schema)], "text string, schema string")


@pytest.mark.parametrize(
    "text, schema",
    [
        ("Insert into FOO/BAR", "FOO"),
        ("Insert into FOO.BAR", "foo"),
        ("INSERT INTO FOO / BAR", "FOO"),
        ("INSERT INTO FOO . BAR", "foo"),
    ],
)
def test_separators(spark, text, schema):
    row = one(spark, text, schema).select(F.upper(remove_first(F.col("text"), F.col("schema"))).alias("r")).first()
    assert row.r == "INSERT INTO BAR"


@pytest.mark.parametrize(
    "text, schema, expected",
    [
        ("from FOO.A, FOO.B", "FOO", "from A, FOO.B"),
        ("from A$B.T", "A$B", "from T"),
        ("from AXB.T", "A.B", "from AXB.T"),
        ("select 1\nfrom FOO.T", "FOO", "select 1\nfrom T"),
        ("from FOO.T", None, None),
        (r"from A\EB.T", r"A\EB", "from T"),
        ("from MYFOO.T", "FOO", "from MYT"),
    ],
)
def test_remove_first(spark, text, schema, expected):
    assert one(spark, text, schema).select(remove_first(F.col("text"), F.col("schema")).alias("r")).first().r == expected


def test_whole_word(spark):
    df = one(spark, "from MYFOO.T, FOO.U", "FOO")
    assert df.select(remove_first(F.col("text"), F.col("schema"), whole_word=True).alias("r")).first().r == "from MYFOO.T, U"


def test_mask_keeps_positions(spark):
    text = "a 'it''s -- x' b -- 'y\nc /* from d\n */ \"e'f\" 'open"
    masked = one(spark, text).select(mask_text(F.col("text")).alias("m")).first().m
    assert len(masked) == len(text)
    assert masked.split() == ["a", "b", "c", '"___"']
    assert masked.index("c") == text.index("c /*")


def references(spark, text):
    df = spark.createDataFrame([(1, text)], "statement_number bigint, statement_text string")
    rows = job.table_references(df).orderBy("seq").collect()
    return [(r.schema, r.name, r.name_start_position) for r in rows]


def names(spark, text):
    return [f"{s}.{n}" if s else n for s, n, _ in references(spark, text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("select * from lib.a x, b as y, lib2/c where d = 1, e", ["LIB.A", "B", "LIB2.C"]),
        ("select 1 from (select 2 from q . r) s left outer join t on 1 = 1", ["Q.R", "T"]),
        ("insert into l.t (a, b) select a, b from u", ["L.T", "U"]),
        ("update l/t set a = 1, b = 2 where c in (select c from v)", ["L.T", "V"]),
        ("merge into a.t x using s on 1 = 1 when matched then update set y = 1", ["A.T", "S"]),
        ("merge into L1.T using L2.SRC on 1 = 1", ["L1.T", "L2.SRC"]),
        ("select trim(both ' ' from name), extract(year from ts) from L1.T1", ["L1.T1"]),
        ("fetch next from C1", []),
        ("fetch c1 into x", []),
        ("with recursive c(a) as (select 1 from b) select * from c, d", ["B", "D"]),
        ("select * from (select 1 from L1.T1) x, L2.T2 y", ["L1.T1", "L2.T2"]),
        ('select 1 from "L1"."T1"', ["L1.T1"]),
        ('select 1 from "a ""b"" (c, from d".x, y', ['a "b" (c, from d.X', "Y"]),
        ("select 1 from ((select 1 from a, b where x in (1, 2)) union (select 2 from c)) u, d join e on f(g, h) = 1, i order by j, k",
         ["A", "B", "C", "D", "E", "I"]),
        ("select (select max(x) from p) q, r from s, (select 1 from t, u group by v, w) z, y where a in (select 1 from b, c)",
         ["P", "S", "T", "U", "Y", "B", "C"]),
        ("select 1 from (a x left join b on 1 = 1), c", ["A", "B", "C"]),
        ("select 1 from a join (b inner join l.c on (1 = 1)) on 2 = 2", ["A", "B", "L.C"]),
        ("select a, case when b = 1 then c end, d from e", ["E"]),
        ("select 1 from t join u using (a, b), v", ["T", "U", "V"]),
        ("select 1 from final table (insert into l.t (a, b) values (1, 2)) x, y", ["L.T", "Y"]),
        ("select 1 from db.l.t", ["L.T"]),
        ("select 1 from a x (c1, c2), table(f(1, 2)) as y, b with ur", ["A", "B"]),
        ("delete from a where b = (select max(c) from d, e)", ["A", "D", "E"]),
        ("select 1 from )a, b( , c", []),
        ("", []),
        ("select a from t for update of a", ["T"]),
        ("select 1 from t where a is distinct from b", ["T"]),
        ("select 1 from table(f(1)) x join lateral (select 1 from k) on 1 = 1", ["K"]),
        ("with w as (select 1 from l.w), v (a) as (select 1 from w) select * from w, v, l.v", ["L.W", "L.V"]),
        ("select 'from x' from t -- join u\n join \"v\" on 1 = 1 /* into w */", ["T", "v"]),
        ("delete from l.t where a$from = 1", ["L.T"]),
        ("values 1", []),
    ],
)
def test_references(spark, text, expected):
    assert names(spark, text) == expected


def test_reference_positions(spark):
    text = "select 'é' from  lib / a x,\n  b"
    for schema, name, position in references(spark, text):
        start = text[position - 1 :].upper()
        assert re.match(rf"{schema}\s*[./]\s*{name}" if schema else name, start)


def test_long_list_and_long_text(spark):
    text = "select '" + "x''y " * 20000 + "' from " + ", ".join(f"l.t{i}" for i in range(400))
    assert names(spark, text) == [f"L.T{i}" for i in range(400)]


REFS = "statement_number bigint, seq int, schema string, statement_text string"


def stripped(spark, rows, **options):
    refs = spark.createDataFrame(rows, REFS)
    return {r.statement_number: r.statement_text_parsed for r in job.strip_references(refs, **options).collect()}


def test_null_schema_modes(spark):
    text = "from A.x, y, B.z"
    rows = [(1, 1, "A", text), (1, 2, None, text), (1, 3, "B", text)]
    assert stripped(spark, rows, mode="skip") == {1: "from x, y, z"}
    assert stripped(spark, rows, mode="stop") == {1: "from x, y, B.z"}
    assert stripped(spark, rows, guarded=False, mode="null") == {1: None}
    leading = [(1, 1, None, text), (1, 2, "A", text), (1, 3, "B", text)]
    assert stripped(spark, leading, mode="stop") == {1: "from x, y, z"}
    with pytest.raises(ValueError):
        stripped(spark, rows, mode="other")


def test_guard_static_and_gaps(spark):
    text = "from QSYS2.a, L.b"
    rows = [
        (1, 1, "QSYS2", text), (1, 2, "L", text),
        (2, 1, "QSYS2", "from QSYS2.a"),
        (3, 1, None, "from a"),
        (4, 2, "L", "from L.a"),
        (5, 1, "L", "from L.a, M.b"), (5, 3, "M", "from L.a, M.b"),
    ]
    assert stripped(spark, rows, mode="stop") == {1: "from a, b", 5: "from a, M.b"}
    assert stripped(spark, rows, keep_static=True)[1] == "from QSYS2.a, b"


def python_chain(text, schemas, mode):
    for i, schema in enumerate(schemas):
        if schema is None:
            if mode == "null":
                return None
            if mode == "stop" and i > 0:
                break
            continue
        pattern = re.escape(schema) + (r"\." if mode == "null" else " *[.|/] *")
        text = re.sub(pattern, "", text, count=1, flags=re.I)
    return text


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    cases=st.lists(
        st.tuples(
            st.text("abAB. /|\n", max_size=30),
            st.lists(st.one_of(st.none(), st.sampled_from(["a", "B", "ab", "A."])), min_size=1, max_size=4),
        ),
        min_size=1,
        max_size=20,
    )
)
def test_chain_equals_brute_force(spark, cases):
    df = spark.createDataFrame(cases, "text string, schemas array<string>")
    for mode in ("null", "stop", "skip"):
        separator = {"separator": r"\."} if mode == "null" else {}
        rows = df.select("text", "schemas", strip_chain(F.col("text"), F.col("schemas"), mode, **separator).alias("r")).collect()
        assert [r.r for r in rows] == [python_chain(r.text, r.schemas, mode) for r in rows]


def test_in_row_equals_rows(spark):
    texts = [
        (1, "select * from L1.a, b join l2/c on 1 = 1"),
        (2, "select 1 from QSYS.a"),
        (3, "values 1"),
        (4, "select 1 from a join L1.b on 1 = 1 join c on 1 = 1 join L1.d on 1 = 1"),
    ]
    df = spark.createDataFrame(texts, "statement_number bigint, statement_text string")
    refs = job.table_references(df)
    for options in ({"mode": "stop"}, {"mode": "skip"}, {"guarded": False, "mode": "null"}, {"keep_static": True}):
        by_rows = sorted(map(tuple, job.strip_references(refs, **options).collect()))
        assert by_rows == sorted(map(tuple, job.strip_statements(df, **options).collect()))
    both = {r.audit: (r.reference_rows, r.statements) for r in job.audit_statements(df).collect()}
    assert both == {
        kind: tuple(job.strip_audit(refs, dirty).first()) for kind, dirty in (("clean", False), ("dirty", True))
    }


def test_xref_skips_null_texts_and_counts_the_rest(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, "b")]
    df = spark.createDataFrame(rows, "statement_number bigint, statement_text_parsed string")
    xref = job.statement_xref(df)
    assert sorted(map(tuple, xref.collect())) == [(2, 1), (2, 2), (4, 4)]
    counts = job.fingerprint_counts(df).first()
    assert (counts.distinct_statements, counts.statements) == (2, 4)


@pytest.mark.parametrize("most", [100, 1])
def test_static_schemas_as_a_table(spark, monkeypatch, most):
    monkeypatch.setattr(job, "MOST_STATIC", most)  # 1: the table is joined
    texts = [
        (1, "select * from L1.a, QSYS2.b"), (2, "select 1 from QSYS.a, b"), (3, "values 1"),
        (4, "select 1 from l2/a join QSYS.b on 1 = 1"), (5, "select 1 from L1.a"),
    ]
    df = spark.createDataFrame(texts, "statement_number bigint, statement_text string")
    refs = job.table_references(df)
    names = ["QSYS2", "QSYS", "L2"]
    table = spark.createDataFrame([(n.ljust(10),) for n in names], "library string")
    for options in ({"mode": "stop"}, {"keep_static": True}, {"guarded": False, "mode": "null"}):
        want = sorted(map(tuple, job.strip_statements(df, static=names, **options).collect()))
        assert want and sorted(map(tuple, job.strip_statements(df, static=table, **options).collect())) == want
        assert sorted(map(tuple, job.strip_references(refs, static=table, **options).collect())) == want
        assert sorted(map(tuple, job.strip_references(refs.drop("statement_text"), static=table, statements=df, **options).collect())) == want
    want = {r.audit: (r.reference_rows, r.statements) for r in job.audit_statements(df, names).collect()}
    assert want == {"clean": (6, 3), "dirty": (3, 2)}
    assert {r.audit: (r.reference_rows, r.statements) for r in job.audit_statements(df, table).collect()} == want
    # Next to a null no schema is known not to be static.
    unknown = table.union(spark.createDataFrame([(None,)], "library string"))
    assert job.strip_statements(df, static=unknown).count() == 0
    assert tuple(job.strip_audit(refs, True, unknown).first()) == (0, 0)
    assert tuple(job.strip_audit(refs, False, unknown).first()) == (6, 3)
    none = table.limit(0)
    assert tuple(job.strip_audit(refs, True, none).first()) == (7, 4)


def test_texts_are_not_shuffled_with_references(spark):
    df = spark.createDataFrame([(1, "select * from L1.a, QSYS2.b")], "statement_number bigint, statement_text string")
    narrow = job.table_references(df).drop("statement_text")
    plan = planned(job.strip_references(narrow, statements=df))
    assert "any_value" not in plan and "first(statement_text" not in plan


def test_a_text_is_cut_once_and_read_word_by_word(spark):
    words = "insert into a.b select extract(year from d), x from l1.t1 p, l2 / t2 join (c.d cross join e), f.g"
    rows = spark.createDataFrame([(1, words), (2, "plain words " * 20_000), (3, "")], "statement_number long, statement_text string")
    found = job.table_references(rows)
    assert [(r.schema, r.name) for r in found.orderBy("seq").collect()] == [
        ("A", "B"), ("L1", "T1"), ("L2", "T2"), ("C", "D"), (None, "E"), ("F", "G"),
    ]
    # One cutting of the text; the pattern of a list in brackets stands once in it.
    assert planned(found).count("cross|inner|left") == 1


def test_a_text_holds_the_character_that_parts_pieces(spark):
    texts = ["select * from a, b\0, c.d", "\0", "from \0x", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "statement_number long, statement_text string")
    found = job.table_references(rows).orderBy("statement_number", "seq").collect()
    assert [(r.statement_number, r.schema, r.name, r.name_start_position) for r in found] == [(0, None, "A", 15), (0, None, "B", 18), (0, "C", "D", 22)]


def test_states_of_long_and_short_arrays(spark):
    sizes = (0, 1, 64, 65, 300)
    rows = [(n, [(i * 7 + n) % 5 for i in range(n)]) for n in sizes]
    df = spark.createDataFrame(rows, "n int, codes array<int>")
    first = F.struct(F.lit(0).alias("last"), F.lit(False).alias("up"))
    step = lambda s, c: F.struct(c.alias("last"), F.when(c == 2, s["up"]).otherwise(c > s["last"]).alias("up"))
    found = {r.n: r.up for r in df.select("n", states(F.col("codes"), first, step, "up").alias("up")).collect()}
    for n, codes in rows:
        last, up, want = 0, False, []
        for c in codes:
            last, up = c, up if c == 2 else c > last
            want.append(up)
        assert found[n] == want
    # What a segment means is told by one walk over the kinds; the plan had two numberings of the events.
    plan = planned(job.table_references(spark.createDataFrame([(1, "x")], "statement_number long, statement_text string")))
    assert "greatest(lambda" not in plan


def test_each_step_of_the_references_is_a_column_of_its_own(spark):
    texts = [
        "select a.x, b.y from LIB.ONE a, two b join q.three c on a.id = b.id where z in (1, 2), w",
        "with k as (select 1 from base) select extract(year from d), 'x, from no' from k, (select * from in_b, l.c) t",
        'select * from "a.b"."c", d -- , e', "merge into t1 using s/t2 on 1 = 1", "", None, "no table", "select 1\u0000, 2 from a, b",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "statement_number int, statement_text string")
    found = job.with_references(rows)
    whole = reference_array(mask_text(F.col("statement_text")), F.col("statement_text"))
    assert all(r.references == r.whole for r in found.withColumn("whole", whole).collect())
    # The mask, the segments, the marked text, its pieces, their spans and the references.
    assert planned(found).count("Generate explode") >= 6
