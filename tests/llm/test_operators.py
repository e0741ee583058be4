"""Operators against brute force on small rows, with nulls, empty texts, ties and repeated rows."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
import pytest

from opsframe.llm import ann, components, exact_dedup, licenses, minhash, mixing, queries, url_filter
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert not differences(queries.QUERIES[name](spark, FOLDER).select("*"), queries.ORACLES[name], connect(FOLDER))


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)


def test_nearest_recall_and_scores(spark):
    found = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = found.collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    near = {}
    for r in ann.nearest(found).collect():
        near.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:20]
        got = near[ids[i]]
        assert len(got) == 20 and all(abs(scores[list(ids).index(v)] - s) < 1e-9 for v, s in got.items())
        hits, total = hits + sum(ids[j] in got for j in order), total + 20
    assert hits / total >= 0.9


def test_nearest_gives_all_candidates_where_there_are_few(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]),
        (6, None), (7, [nan, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (20, [0.0, 2.0]),
    ]
    out = ann.nearest(vectors(spark, rows)).collect()
    of = lambda q: [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q]
    assert of(0) == [(2, 1.0), (3, 1.0), (20, 0.0), (4, -1.0)]
    assert [v for v, _ in of(20)] == [0, 2, 3, 4]
    assert ann.nearest(vectors(spark, [])).count() == 0


def test_exact_groups_edges(spark):
    rows = [(1, "a b"), (2, "ab "), (3, "a  b"), (4, None), (5, ""), (5, ""), (None, "x"), (6, "x")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _sha string")
    out = exact_dedup.exact_groups(docs, rows_per_run=2, fan_in=2).collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) == 3
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].keep_id == 3 and by_id[1].group_size == 3 and by_id[6].kept and not by_id[None].kept
    assert {by_id[i].keep_id for i in (4, 5)} == {5} or {by_id[i].keep_id for i in (4, 5)} == {4}
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "777 as _run", "888L as _row", "9 as _length", "'s' as _sha", "1 as _best")
    names = ("_run", "_row", "_length", "_sha", "_best")
    for fan_in, size in ((2, 1), (8, 25_000)):
        held = exact_dedup.exact_groups(clashing, *names, rows_per_run=size, fan_in=fan_in).collect()
        assert all(tuple(r[n] for n in names) == (777, 888, 9, "s", 1) for r in held)
        assert sorted((str(r.doc_id), r.group_size, r.kept) for r in held) == sorted((str(r.doc_id), r.group_size, r.kept) for r in out)


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows):
    """{doc_id: smallest doc_id reachable} by comparing all sets."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in sets}


def edited(rnd, words, edits):
    words = list(words)
    for at in rnd.sample(range(len(words)), edits):
        words[at] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [8, 1024])
def test_near_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(11)
    rows, base = [], [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows += [edited(rnd, base, rnd.randint(1, 4)) for _ in range(60)]  # mostly linked
    family = [f"t{rnd.randrange(5000)}" for _ in range(150)]
    rows += [edited(rnd, family, 5) for _ in range(60)]  # near the threshold, on both sides
    chain = [f"c{i}" for i in range(120)]
    for _ in range(15):  # each is linked with the next one only
        chain = chain[6:] + [f"c{rnd.randrange(10**6)}" for _ in range(6)]
        rows.append(" ".join(chain))
    rows += [" ".join(f"x{rnd.randrange(300)}" for _ in range(rnd.randint(1, 40))) for _ in range(40)] + [rows[0], rows[0].upper(), "", None]
    # 75 shingles in common: of a union of 100, 100 and 75, and next to the threshold.
    shared = [f"s{i}" for i in range(79)]
    rows += [" ".join(shared + [f"p{i}" for i in range(12)]), " ".join(shared + [f"q{i}" for i in range(13)])]
    rows += [" ".join(shared[:79] + [f"r{i}" for i in range(25)]), " ".join(shared)]
    docs = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    rnd.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs)
    assert len(set(want.values())) < len(want) - 60
    got = {r.doc_id: r for r in minhash.near_groups(table).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t)) for i, t in docs)
    left = {r.doc_id: r.text for r in minhash.one_of_each(table, "text").collect()}
    assert left == {i: t for i, t in docs if want[i] == i}


def test_near_groups_keep_one_of_each(spark):
    words = [f"w{i}" for i in range(80)]
    near = " ".join([*words[:-1], "other"])
    rows = [(3, " ".join(words)), (1, near), (1, near), (None, near), (7, None), (8, ""), (9, "alone in here")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, root string")
    out = minhash.near_groups(docs, "text", "root").collect()
    assert sum(r.stays for r in out) == 4 and {r.component_id for r in out if r.n_shingles > 10} == {1}
    assert all(r.root == "s" for r in out) and {r.text for r in out} == {t for _, t in rows}
    assert minhash.near_groups(docs.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 40), [None, "a", "b", "c"][i % 4]) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, "source").collect()
    for source in (None, "a", "b", "c"):
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK_WORDS
    assert all(r.taken <= 3 * r.size for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_url_filter_as_of_equals_brute_force(spark):
    draw, day = random.Random(1), dt.date(2024, 1, 1)
    hosts = ["a.com", "x.a.com", "b.org", "b.org/p", "b.org/p/q"]
    entries = [
        (draw.choice("st"), draw.choice(hosts), day + dt.timedelta(start), draw.choice([None, day + dt.timedelta(start + draw.randrange(-2, 9))]))
        for start in (draw.randrange(60) for _ in range(40))
    ]
    entries = [e for e in entries if e[3] or draw.random() < 0.2]
    urls = ["http://X.a.com:80/z?q#f", "https://u@b.org/p/q/r", "b.org/pp", "", None, "http://c.net"]
    captures = [(i, draw.choice(urls), draw.choice([None, *[dt.datetime(2024, 1, 1, 5) + dt.timedelta(d) for d in range(70)]])) for i in range(300)]
    cover = {urls[0]: {"a.com", "x.a.com"}, urls[1]: {"b.org", "b.org/p", "b.org/p/q"}, urls[2]: {"b.org"}}
    listed = spark.createDataFrame([*entries, (None, "a.com", day, None), ("s", None, day, None), ("s", "a.com", None, None)], "category string, pattern string, listed_on date, removed_on date")
    found = spark.createDataFrame([(*c, 1) for c in captures], "id long, url string, fetched_at timestamp, day int")
    out = {r.id: r.evidence for r in url_filter.url_filter(found, listed, "id").collect()}
    for i, url, at in captures:
        on = at and at.date()
        hits = {f"{c}:{p}" for c, p, a, b in entries if on and p in cover.get(url, ()) and a <= on and (b is None or on < b)}
        assert out[i] == ",".join(sorted(hits)), (url, at)
    assert url_filter.url_filter(found.limit(0), listed, "id").count() == 0


def test_licenses_in_other_spelling(spark):
    mit = licenses.KNOWN[7][1]
    varied = "Copyright (c) 2020 Someone\r\n\r\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace(" ", "\n", 9)
    rows = [(1, varied), (2, "text\nreleased under the mit licence!\nmore"), (3, None), (4, ""), (5, "released under the MIT License. Not."), (2, "text")]
    docs = spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, digest string")
    out = licenses.license_scan(docs, licenses.known_licenses(spark)).collect()
    assert sorted((r.doc_id, r.whole, r.licenses, r.n_parts) for r in out if r.licenses) == [(1, "MIT", "MIT", 1), (2, None, "MIT", 1)]
    assert len(out) == len(rows)
    assert licenses.license_scan(docs.limit(0), licenses.known_licenses(spark)).count() == 0


def test_a_group_of_near_copies_gives_few_candidates_an_entry(spark, monkeypatch):
    counted = []
    whole = minhash.map_arrow

    def counting(df, function, schema):
        made = whole(df, function, schema)
        if schema == "a long, b long, equal int":
            counted.append(made.count())
        return made

    monkeypatch.setattr(minhash, "map_arrow", counting)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*words[:i], f"own{i}", *words[i + 1 :]]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = minhash.near_groups(docs).collect()
    assert {row.component_id for row in found} == {0} and sum(row.kept for row in found) == 1
    # A few hubs for each of 40 entries, however many buckets they share.
    assert counted and max(counted) <= 4 * 40


def test_near_groups_list_the_keys_of_a_few_tables_a_round(spark, monkeypatch):
    counted = []
    whole = minhash.settle

    def counting(df):
        made = whole(df)
        if "bucket" in made.columns:
            counted.append(made.count())
        return made

    monkeypatch.setattr(minhash, "settle", counting)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join([*words[:i], f"own{i}", *words[i + 1 :]])) for i in range(40)]
    found = minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {row.component_id for row in found} == {0}
    # The keys of all 256 tables that these entries share are several times as many.
    assert counted and sum(counted) <= 40 * 2 * 2 * minhash.GROUPS


def test_texts_nearly_similar_enough_are_not_listed(spark, monkeypatch):
    counted = []
    whole = minhash.map_arrow

    def counting(df, function, schema):
        made = whole(df, function, schema)
        if schema == "a long, b long":
            counted.append(made.count())
        return made

    monkeypatch.setattr(minhash, "map_arrow", counting)
    rnd = random.Random(3)
    family = [f"t{i}" for i in range(150)]
    docs = [(i, edited(rnd, family, 5)) for i in range(80)]  # next to the threshold, on both sides
    found = minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_components(docs)
    assert {row.doc_id: row.component_id for row in found} == want and len(set(want.values())) > 10
    # The last comparison gives links that join components, not all that might be links.
    assert len(counted) == 1 and counted[0] < 4 * len(docs)


@pytest.mark.parametrize("least", [50, 75, 100])
def test_sets_are_compared_in_full(least):
    rnd = random.Random(least)
    sets = [np.unique(np.array([rnd.randrange(40) for _ in range(rnd.randint(1, 60))], dtype=np.uint64)) for _ in range(60)]
    for own in sets:
        want = [100 * len(set(own) & set(x)) >= least * len(set(own) | set(x)) for x in map(list, sets)]
        assert minhash.linked_with(own, sets, least).tolist() == want


def test_more_links_join_components(spark):
    rnd = random.Random(8)
    rows = [[(rnd.randrange(60), rnd.randrange(60)) for _ in range(n)] for n in (25, 12)]
    first, more = (spark.createDataFrame(links, "a long, b long") for links in rows)
    found = components.more_joined(components.components(first), more)
    want = components.components(first.unionByName(more))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
