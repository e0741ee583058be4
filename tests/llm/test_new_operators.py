"""Periodic runs, the filter audit and chat examples on small rows, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsframe.llm import chat, filter_audit, periodic
from opsframe.llm.suffix_tree import SuffixTree, next_smaller


def brute_runs(s, least=2, words=0):
    """Every maximal stretch with a period, at its smallest period, by comparing all places."""
    found = {}
    for q in range(1, len(s) // least + 1):
        equal = [s[i] == s[i + q] for i in range(len(s) - q)]
        i = 0
        for same, group in itertools.groupby(equal):
            n = len(list(group))
            if same and n + q >= max(words, least * q):
                found.setdefault((i, n + q), q)  # the first one is the smallest
            i += n
    return sorted((start, length, q) for (start, length), q in found.items())


sequences = st.one_of(
    st.lists(st.integers(1, 3), min_size=1, max_size=60),
    st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 9), st.lists(st.integers(1, 4), max_size=6)).map(
        lambda x: x[0] * x[1] + x[2]
    ),
)


@settings(max_examples=300, deadline=None)
@given(sequences)
def test_runs_equal_brute_force(s):
    assert sorted(zip(*[x.tolist() for x in periodic.all_runs(np.array(s))], strict=True)) == brute_runs(s)
    for least, exponent in ((6, 4), (1, 2), (9, 3)):
        found = periodic.runs_of([str(x) for x in s], least, exponent)
        assert sorted(found) == brute_runs(s, exponent, least)


@settings(max_examples=100, deadline=None)
@given(sequences)
def test_suffix_tree_ranks_and_extensions(s):
    tree = SuffixTree(np.array(s))
    closed = [*s, 0]
    order = sorted(range(len(closed)), key=lambda i: closed[i:])
    assert tree.ranks.tolist() == [order.index(i) for i in range(len(closed))]
    other = sorted(range(len(closed)), key=lambda i: [-x if x else -99 for x in closed[i:]])
    assert tree.ranks_reversed().tolist() == [other.index(i) for i in range(len(closed))]
    pairs = [(i, j) for i in range(len(closed)) for j in range(i)]
    if pairs:
        i, j = map(np.array, zip(*pairs, strict=True))
        wanted = [next((k for k in range(len(closed)) if closed[a + k] != closed[b + k]), 0) for a, b in pairs]
        assert tree.common(i, j).tolist() == wanted
    # Each longest Lyndon word is smaller than all its rotations.
    for i, end in enumerate(next_smaller(tree.ranks).tolist()):
        word = s[i:end]
        assert all(word < word[k:] + word[:k] for k in range(1, len(word)))


def test_periodic_runs_edges(spark):
    long = " ".join(["one", "two", "three"] * 20_000)
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "x a b a b a b a b y"),
        (6, "a b a b a b a b c d c d c d c d"), (7, long), (8, "é é é é é é é é é é é é end"),
    ]
    docs = spark.createDataFrame([(i, t, 9, "k") for i, t in rows], "doc_id long, text string, _carry0 int, words string")
    found = periodic.periodic_runs(docs, "_carry0", "words").collect()
    assert len(found) == len(rows) and all((r._carry0, r.words) == (9, "k") for r in found)
    of = {r.doc_id: r for r in found}
    assert all(of[i].runs == [] and of[i].best is None and of[i].collapsed == "" for i in (1, 2, 3))
    assert of[4].runs == [] and of[4].collapsed == "a a a a a"  # fewer than six words
    assert [tuple(r) for r in of[5].runs] == [(0, 6, 1)] and of[5].collapsed == "a"
    assert tuple(of[None].best) == (1, 8, 2) and of[None].collapsed == "x a b y"
    assert tuple(of[6].best) == (0, 8, 2) and len(of[6].runs) == 2  # a tie: the smaller start
    assert tuple(of[7].best) == (0, 60_000, 3) and of[7].collapsed == "one two three"
    assert of[8].collapsed == "é é end"
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, least_exponent=1)


def test_run_digests_of_planted_documents_equal_brute_force(spark):
    import zlib

    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(docs))).collect()}
    for i, text in rows:
        words = text.split()
        h, n = zlib.crc32(str(i).encode()), len(text.split())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        runs = sorted(brute_runs(words, 4, 6), key=lambda r: (r[0], r[2]))
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        exponent = 1000 * best[1] // best[2] if runs else None
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[i]) == (i, len(runs), *best, exponent, digest(listed), digest(kept))


def brute_audit(docs, labels):
    labels = [x for x in labels if x[0] is not None]
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, bad in labels if bad == 1}
    ids = {}
    for i, text, _ in docs:
        ids.setdefault(text or "", []).append(i)
    fails, out = [], {}
    for i, text, source in docs:
        text = text or ""
        words = text.split()
        same = [x for x in ids[text] if x is not None]
        bits = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": any(i is None or x < i for x in same),
        }
        fails.append((i, source or "", {k for k, v in bits.items() if v}))
    for part in {p for _, p, _ in fails}:
        rows = [(i, f) for i, p, f in fails if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [i for i, f in rows if letter in f and not f & before]
                shapley[letter] += len(removed)
                out[part, "".join(order), step] = [
                    sum(not f & {*before, letter} for _, f in rows), len(removed), sum(letter in f and bool(f & before) for _, f in rows),
                    sum(f == {letter} for _, f in rows), sum(i in good for i in removed), sum(i in toxic for i in removed), letter,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = shapley[row[6]]
    return out


def test_filter_audit_equals_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["w" + str(k) for k in range(rnd.choice([5, 400]))], k=rnd.choice([3, 150, 300]))) for _ in range(12)]
    texts += [texts[0] + " #", "ABC " + texts[1], "", None, "word " * 9000]
    docs = [(i, rnd.choice(texts), rnd.choice(["a", "b", None, ""])) for i in range(60)]
    docs += [(None, texts[0], "a"), (None, texts[0], "a"), (3, docs[3][1], "b"), (3, docs[3][1], "b")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 60, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, source string, mask int, n int, part string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(table, said).collect()}
    assert got == brute_audit(docs, labels)
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert filter_audit.audit(table.limit(0), said.limit(0)).count() == 0
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_filter_audit_has_no_row_limit(spark):
    docs = spark.range(3500).selectExpr("id as doc_id", "'t' as text", "cast(id as string) as source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 3500 * 600  # 1.1 million prefixes


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_blocks_leave_nothing_out_of_the_count(spark, block):
    turns = [(c, t, "assistant" if t % 3 else "user", "x" * (t + c)) for c in range(4) for t in range(1 + 5 * c)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r.formatted_chars for r in chat.read_back(chat.format_conversations(rows, block_turns=block)).collect()}
    written = lambda said: sum(len(f"[INST]{r}[/INST]{t}</s>") for _, _, r, t in said)
    want = {}
    for conv, said in itertools.groupby(turns, lambda t: t[0]):
        said = list(said)
        closing = {i + 1 for i, t in enumerate(said) if t[2] == "assistant"} | {len(said)}
        want[conv] = sum(written(said[:n]) for n in closing)
    assert found == want


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_every_example_holds_all_turns_before_its_reply(spark, block):
    turns = [(c, t, "assistant" if t % 3 else "user", f"{c}.{t}</s>" + "y" * t) for c in (0, 1, None) for t in range(2 + 5 * (c or 0))]
    turns += [(7, t, "user", f"no reply {t}") for t in range(8)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    want = []
    for conv, said in itertools.groupby(turns, lambda t: t[0]):
        said = [(r, t.replace("</s>", "<\\/s>")) for _, _, r, t in said]
        for n, (role, text) in enumerate(said, 1):
            if role == "assistant" or n == len(said):
                whole = "".join(f"[INST]{r}[/INST]{t}</s>" for r, t in said[:n])
                want.append((conv, n, n - 1 if role == "assistant" else None, whole, text if role == "assistant" else None, n == len(said)))
    examples = chat.format_conversations(rows, block_turns=block).collect()
    loss = lambda r: None if r.target is None else r.text[r.loss_start : r.loss_end]
    found = [(r.conv_id, r.n_turns, r.target, r.text, loss(r), r.closes) for r in examples]
    assert sorted(found, key=str) == sorted(want, key=str)


def expected_chat(turns):
    out = {}
    key = lambda t: (t[0] is not None, t[0] or 0, t[1] is None, t[1] or 0, t[2] or "", t[3] or "")
    for conv, rows in itertools.groupby(sorted(turns, key=key), lambda t: t[0]):
        said = [(r or "", t or "") for _, _, r, t in rows]
        loss = "".join(t for r, t in said if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(said), digest("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), digest(loss))
    return out


ODD = [
    None, "", "</s>[INST] ok [/INST]", "\\", "a\\b\\\\", "<\\s>", "<<s>s>", "<", "[", "</s></s>", "<<SYS>>x<</SYS>>", "[INST][/INST", "\n\n", "é👍<|im_end|>",
    "[[INST]]", "</", "s>", "x" * 200_000,
]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_chat_round_trip(spark, block):
    rnd = random.Random(7)
    turns = [(c, t, rnd.choice(["user", "assistant", "system", None, "a[/INST]b"]), rnd.choice(ODD)) for c in range(12) for t in range(rnd.randint(1, 9))]
    turns += [(20, 0, "user", "x")] * 3 + [(21, None, "assistant", t) for t in ODD] + [(None, 1, "user", "y"), (None, 0, "assistant", "z")]
    rows = spark.createDataFrame([(*t, 5, "b") for t in turns], "conv_id long, turn long, role string, text string, place int, block string")
    examples = chat.format_conversations(rows, block_turns=block)
    found = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(examples).collect()}
    assert found == expected_chat(turns)
    # One example for each reply, and its context is all that was said before.
    whole = chat.whole_examples(examples).collect()
    assert len(whole) == sum(r == "assistant" for _, _, r, _ in turns)
    apart = {(r.conv_id, r.target): (r.text, r.text[r.loss_start : r.loss_end]) for r in whole}
    joined = {(r.conv_id, r.target): (r.text, r.text[r.loss_start : r.loss_end]) for r in chat.whole_examples(chat.format_conversations(rows)).collect()}
    assert apart == joined
    for text, loss in apart.values():
        assert text.endswith(f"[INST]assistant[/INST]{loss}</s>")
        assert not any(mark in loss for mark in chat.CONTROL)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="<>/s[]INST\\|", max_size=30), min_size=50, max_size=90))
def test_escaping_is_reversible(spark, found):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in found], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in rows.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert r.back == r.t and not any(mark in r.e for mark in chat.CONTROL)


def test_chat_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).count() == 0
    assert [tuple(r)[:3] for r in chat.format_conversations(chat.with_control_turns(empty)).collect()] == [(-1, 0, 1)]
    with pytest.raises(ValueError):
        chat.format_conversations(empty, block_turns=0)
