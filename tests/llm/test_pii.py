from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsframe.llm.pii import KINDS, _identity, base_spans, entity_classes, personal_data, span_digest
from opsframe.sources.durable import settle

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 // 10 + d * 2 % 10
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def expected(text):
    spans = [
        (m.start(), KINDS.index(k), m.end()) for k in KINDS for m in re.finditer(BASE[k], text or "") if valid(k, m.group())
    ]
    joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest(), joined)


CASES = [
    None, "", "a@b.c", "a@b.c_d@e.f", "x a@b.c@d.e.f y", "@a.b", "a@b", "+1 (743) 555-3824", "é +1 (743) 555-3824.", "4785380592391139",
    "4785 3805 9239-1139", "4785  3805", "1.2.3.4.5.6.7.8", "256.1.1.1 255.0.0.01", "00000000001.2.3.4", "99999999999999999999.1.1.1",
    "1" * 5000, "a" * 20000, "a" * 5000 + "@", "a.b@" * 500, "+1" * 500, "👍 me@x.org 👍 10.0.0.1", "+12345678901234567 4111111111111111",
    "a@b.c,d@e.f;g@h.i.", "1.2.3 1.2.3.4", "+1-----2 +123456789", "x@-.-", "12 34 56 78 90 12 34 5",
]


def rows_of(spark, found):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(found)], "doc_id long, text string, spans string, mentions int")
    return {r.doc_id: tuple(r)[1:] for r in span_digest(personal_data(docs, with_text=False)).collect()}


def test_base_spans_equal_the_patterns(spark):
    found = rows_of(spark, CASES)
    for i, text in enumerate(CASES):
        want = expected(text)
        assert found[i][:5] == want[:5], text
        assert set(filter(None, want[5].split(","))) <= set(found[i][5].split(","))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="a1@.+- (9_é5", max_size=60), min_size=50, max_size=80))
def test_base_spans_of_any_text(spark, found):
    got = rows_of(spark, found)
    for i, text in enumerate(found):
        assert got[i][:5] == expected(text)[:5], text


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in span_digest(personal_data(docs, with_text=False)).collect():
        want = expected(texts[r.doc_id])
        assert tuple(r)[1:6] == want[:5]
        assert set(filter(None, want[5].split(","))) <= set(r.spans.split(","))


WORD = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text):
    return [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]


def disclosed(texts, generalise=0.9, remove=0.95, witnesses=1):
    """{text: {(start, end): removed}} by pointwise mutual information over different texts."""
    texts = set(texts)
    where, entities = {}, {}
    for text in texts:
        for _, _, word in words_of(text):
            where.setdefault(word, set()).add(text)
        for kind, pattern in BASE.items():
            for m in re.finditer(pattern, text):
                if valid(kind, m.group()):
                    value = re.sub("[^0-9]", "", m.group()) if kind in ("card", "phone") else m.group().lower()
                    entities.setdefault((kind, value), set()).add(text)
    told = {}
    for holders in entities.values():
        information = math.log2(len(texts) / len(holders))
        for word, at in where.items():
            both = len(at & holders)
            if both >= max(witnesses, 1) and information > 0:
                share = math.log2(both * len(texts) / (len(holders) * len(at))) / information
                told[word] = max(share, told.get(word, -1))
    out = {}
    for text in texts:
        spans = [(m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m.group())]
        out[text] = {
            (s, e): told[w] >= remove - 1e-12 for s, e, w in words_of(text)
            if told.get(w, -1) >= generalise - 1e-12 and not any(a < e and b > s for a, b in spans)
        }
    return out


def terms_of(spans):
    return {(s.start, s.end): s.value == "removed" for s in spans if s.kind == len(KINDS)}


@pytest.mark.parametrize("limits", [(0.9, 0.95, 1), (0.5, 0.9, 1), (0.8, 0.95, 2)])
def test_terms_equal_brute_force(spark, limits):
    rnd = random.Random(4)
    common = ["the", "of", "and", "é", "人", "to", "x9"]
    people = [f"p{i}@mail.org" for i in range(8)] + ["10.0.0.1", "+1 (743) 555-3824", "4785380592391139"]
    texts = []
    for i in range(300):
        words = rnd.choices(common, k=rnd.randint(0, 12)) + rnd.choices([f"w{k}" for k in range(200)], k=rnd.randint(0, 8))
        if i % 5 == 0:
            who = rnd.sample(range(len(people)), rnd.randint(1, 2))
            words += [people[k] for k in who] + [f"Nick{k}" for k in who] + [f"only{i}"] * 2
        if i % 7 == 0:
            words += [f"nick{rnd.randrange(11)}"]
        rnd.shuffle(words)
        texts.append(rnd.choice([" ", ", ", "\n"]).join(words))
    rows = texts + texts[:40] * 3 + [None, ""]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, term int")
    want = disclosed([t or "" for t in rows], *limits)
    got = {r.doc_id: r for r in personal_data(docs, True, *limits).collect()}
    assert sum(map(len, want.values())) > 20 and len(got) == len(rows)
    for i, text in enumerate(rows):
        assert terms_of(got[i].spans) == want[text or ""], text
        for (start, end), removed in terms_of(got[i].spans).items():
            assert removed is False or WORD.search(text[start:end])


def test_terms_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = disclosed(texts.values())
    found = personal_data(docs, with_text=False).collect()
    assert all(terms_of(r.spans) == want[texts[r.doc_id]] for r in found)
    assert sum(bool(terms_of(r.spans)) for r in found) > 20


def test_planted_terms_are_found_among_many_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    leaks = [(10**6 + i, f"the Zybulon of anna.z@mail.org, case {i}") for i in range(3)] + [(10**6 + 9, "zybulon was here")]
    found = personal_data(docs.union(spark.createDataFrame(leaks, docs.schema))).where("doc_id >= 1000000").collect()
    for r in found:
        assert "zybulon" not in r.sanitised.lower() and "anna.z" not in r.sanitised
    assert len(found) == 4 and all(" of " in r.sanitised for r in found if r.base_spans)


def test_terms_in_documents_that_name_no_entity_are_marked(spark):
    noise = [(100 + i, f"common words about item{i % 40} and other item{i % 7} things") for i in range(400)]
    leaks = [(i, f"reach plumberjones about case{i} at jones@mail.org or visit common words") for i in range(6)]
    apart = [(50, "common plumberjones " + "words and other things " * 90 + "PlumberJones")]
    docs = spark.createDataFrame(noise + leaks + apart, "doc_id long, text string")
    rows = {r.doc_id: r for r in personal_data(docs).collect()}
    assert all("common words" in rows[i].sanitised for i, _ in noise)
    for i, _ in leaks:
        assert "plumberjones" not in rows[i].sanitised and "[EMAIL]" in rows[i].sanitised and "jones@" not in rows[i].sanitised
    assert "lumber" not in rows[50].sanitised and "words and other things" in rows[50].sanitised


def test_copies_are_one_witness(spark):
    noise = [(100 + i, f"common words about item{i}") for i in range(300)]
    copies = [(i, "secret handshake of anna@mail.org is known") for i in range(9)]
    docs = spark.createDataFrame(noise + copies, "doc_id long, text string")
    assert all(s.kind < len(KINDS) for r in personal_data(docs, witnesses=2).collect() for s in r.spans)
    # Nor do copies hide a term.
    more = [(50 + i, f"place{i} handshake of anna@mail.org known{i}") for i in range(2)]
    docs = spark.createDataFrame(noise + copies + more, "doc_id long, text string")
    rows = {r.doc_id: r.sanitised for r in personal_data(docs, witnesses=2).collect()}
    assert all("handshake" not in rows[i] for i, _ in copies + more)


def test_many_entities_of_one_text_are_one_class(spark):
    docs = spark.createDataFrame([(1, " ".join(f"u{i}@mail.org" for i in range(3000)) + " listed"), (2, "other"), (3, "more")], "doc_id long, text string")
    rows = settle(docs.select(_identity(F.col("text")), base_spans(F.col("text")).alias("spans")))
    assert entity_classes(rows).count() == 1
    assert [s.kind for r in personal_data(docs).collect() for s in r.spans if s.kind == len(KINDS)] == [len(KINDS)]


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal_data(docs).collect()
    assert len(found) == len(rows)
    assert all(r.sanitised == ("[EMAIL]" if t else "") for r, (_, t) in zip(sorted(found, key=str), sorted(rows, key=str), strict=True))
