from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opsframe.llm.packing import K1, B, Encoder, Shard, pack, piece_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a", "a ", "a  b", "a \n b\n\n  c", "x <|endoftext|> y<|endoftext|>z", "\x1c a\x1c b", "it's we'll I'M",
    "a b   c", "日本 語 한국어", "\n a", "a\n b \nc", "é é ß", "👍🏽 ok", "word " * 700, "x" * 5000,
]


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def check(pieces, rows, window=1024):
    """Every document's ids once, gapless sequences of at most the window."""
    by_row, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_row[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    expected = defaultdict(list)
    for doc_id, text in rows:
        expected[doc_id].append(library_ids(text))
    assert set(by_row) == set(expected)
    for doc_id, wanted in expected.items():
        if len(wanted) > 1:
            assert sum(p.length for p in by_row[doc_id]) == sum(map(len, wanted))
            continue
        at = 0
        for p in sorted(by_row[doc_id], key=lambda p: p.start):
            raw = np.array(wanted[0][p.start : p.start + p.length], dtype="<u4").tobytes()
            assert p.start == at and p.length > 0 and p.doc_tokens == len(wanted[0]) and p.ids_crc32 == zlib.crc32(raw)
            at += p.length
        assert at == len(wanted[0])
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sequences


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(PATH)
    encoder = Encoder(PATH, kept=10)
    for _ in range(2):
        for text, ids in zip(ODD, encoder.encode(ODD), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_all_documents_are_packed_whole_with_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = piece_digests(pack(docs, PATH, shard_docs=50)).collect()
    sequences = check(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    tokens = sum(p.length for p in pieces)
    assert len(sequences) - tokens / 1024 < 8 + 1  # less than one window a task


def test_neighbours_share_windows(spark):
    topics = ["red apple pie", "steel bridge load", "violin sonata score"]
    rows = [(i, f"{topics[i % 3]} " * 5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = pack(docs, PATH, window=64).collect()
    mates = defaultdict(set)
    for p in pieces:
        mates[p.sequence_id].add(p.doc_id % 3)
    assert sum(len(topics) == 1 for topics in mates.values()) >= len(mates) - 3


@pytest.mark.parametrize("window", [1, 7, 1024])
def test_edges(spark, window):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "unnamed"), (4, "long " * 3000), *[(10 + i, t) for i, t in enumerate(ODD[:6])]]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids int, near string")
    check(piece_digests(pack(docs, PATH, window=window)).collect(), rows, window)
    assert pack(docs.limit(0), PATH).count() == 0


def bm25(docs, ids):
    """Scores of all documents for one of them, straight from the formula."""
    n, mean = len(docs), sum(len(d) + 1 for d in docs) / len(docs)
    frequency = Counter(t for d in docs for t in set(d))
    out = []
    for d in docs:
        counts, norm = Counter(d), K1 * (1 - B + B * (len(d) + 1) / mean)
        idf = lambda t: math.log1p((n - frequency[t] + 0.5) / (frequency[t] + 0.5))
        out.append(sum(idf(t) * counts[t] * (K1 + 1) / (counts[t] + norm) for t in set(ids) if t in counts))
    return np.array(out)


def test_the_index_equals_bm25():
    rnd = random.Random(1)
    docs = [[rnd.randrange(1, 60) for _ in range(rnd.randint(0, 40))] for _ in range(50)] + [[], [7] * 300]
    n, frequency = len(docs), Counter(t for d in docs for t in set(d))
    idf = np.zeros(61, dtype=np.float32)
    for term, count in frequency.items():
        idf[term] = math.log1p((n - count + 0.5) / (count + 0.5))
    shard = Shard([np.array([*d, 0], dtype="<u2") for d in docs], idf, sum(len(d) + 1 for d in docs) / n, 0)
    for seed, ids in enumerate(docs):
        assert np.allclose(shard.scores(seed), bm25(docs, ids), rtol=1e-5)
    shard.use(3)
    assert 3 not in shard.neighbours(5) and len(shard.neighbours(5)) == n - 1


def test_rare_terms_bring_documents_into_one_shard(spark):
    """Of planted neighbours, which share rare words in common prose, most share a window."""
    rnd = random.Random(3)
    tokens = sorted(t[1:] for t in Tokenizer.from_file(PATH).get_vocab() if t[0] == "\u0120" and t[1:].isascii() and t[1:].islower() and len(t) > 5)
    chosen = rnd.sample(tokens, 760)  # words of one token
    common, rows = chosen[720:], []
    for group in range(60):
        rare = chosen[12 * group : 12 * group + 12]
        for _ in range(3):
            words = rnd.choices(common, k=60) + rare
            rnd.shuffle(words)
            rows.append((len(rows), " ".join(words)))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = defaultdict(set)
    for p in pack(docs, PATH, shard_docs=30).collect():
        held[p.sequence_id].add(p.doc_id)
    together = sum(any({a, b} <= own for own in held.values()) for g in range(60) for a, b in ((3 * g, 3 * g + 1), (3 * g, 3 * g + 2), (3 * g + 1, 3 * g + 2)))
    assert together / 180 > 0.3  # 8% by chance
