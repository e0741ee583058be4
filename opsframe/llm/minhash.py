"""Near duplicates by MinHash with tensored banding.

A table key needs 2 h minima. Instead of computing them for each of m² tables, two
collections of m groups of h minima are computed, and the key of table (i, j) is the
i-th group of one with the j-th group of the other: 2 m h minima in the place of
2 m² h. A pair of similarity s meets in some table with probability
(1 - (1 - s^h)^m)², for the defaults 0.9997 at 0.75 and more above.

Keys are made only where they can match: a group that no other document has takes no
part, so most documents never form a key. Equal sets are one entry from the start.

A round lists the buckets of a few diagonals of the m by m tables, other ones each time.
In a bucket every entry meets a few hubs, entries of it that are drawn by a hash.
An entry is compared with those of all its buckets' hubs that it shares most buckets with;
of those it agrees with by their minima, cut to bytes, the best one goes on.
So an entry has one candidate a round, and a group of copies falls together in a round
or two without its pairs being listed. No round lists the keys of all tables. The entries
that have groups of both collections with other components meet by those of the first, in
blocks of bounded size; those of different components that share any table are compared, each two once,
first by the same bytes, then by a sketch ten times as long and, if they could be
links (five standard deviations allowed), on their full sets, which the block holds.
A block gives the links that join its components, fewer than it has entries: texts
that are nearly similar enough are compared there and listed nowhere. All candidates
are confirmed on full sets. No bucket is held by one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import WordHasher, batch, map_arrow, mixed, numbered, random_longs, shingle_set, with_columns
from opsframe.llm.components import components, more_joined
from opsframe.operators.lookup import weighted_lookup
from opsframe.sources.durable import discard, settle

WORDS = 5
SIMILARITY = 0.75
GROUPS = 16
MINIMA = 3
HUBS = 3
MET = 4  # hubs that an entry is compared with in a round
ROUNDS = 2
DIAGONALS = 2  # of tables in a round
WIDE = 1024  # minima of the long sketch; it begins with those of the short one
BLOCK = 1024  # entries compared with as many others in a task
BLOCK_SHINGLES = 2_000_000  # and so many shingles of theirs
_STEP = 4096  # shingles whose minima are computed at once
_SEED = 23

_SIGNATURES = "doc_id long, text string, n_shingles long, set_key binary, halves array<long>, sketch binary"
_SIGNATURE_TYPES = {
    "doc_id": pa.int64(), "text": pa.string(), "n_shingles": pa.int64(), "set_key": pa.binary(),
    "halves": pa.list_(pa.int64()), "sketch": pa.binary(),
}


def minima(found: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    least = np.full(len(functions), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), _STEP):
        np.minimum(least, (found[at : at + _STEP, None] * functions).min(axis=0), out=least)
    return least


def _bytes(least: np.ndarray) -> bytes:
    return (mixed(least) & np.uint64(255)).astype(np.uint8).tobytes()


def _signed(words: int, groups: int, rows: int, carry: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        functions = random_longs(2 * groups * rows, _SEED)
        slots = random_longs(2 * groups, _SEED + 1)
        for docs in batches:
            out: dict[str, list] = {name: [] for name in _SIGNATURE_TYPES}
            for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
                found = shingle_set(hasher.words(text or ""), words)
                halves, key, sketch = [], None, None
                if len(found):
                    least = minima(found, functions)
                    half = slots.copy()
                    for column in least.reshape(2 * groups, rows).T:
                        half = mixed(half + column)
                    halves = half.view(np.int64)
                    key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    sketch = _bytes(least)
                for name, value in zip(_SIGNATURE_TYPES, (doc_id, text, len(found), key, halves, sketch), strict=True):
                    out[name].append(value)
            yield with_columns(batch(out, _SIGNATURE_TYPES), docs, carry)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for docs in batches:
            found = [shingle_set(hasher.words(text), words).view(np.int64) for text in docs.column("text").to_pylist()]
            yield batch({"entry": docs.column("entry"), "shingles": found}, {"entry": pa.int64(), "shingles": pa.list_(pa.int64())})

    return run


def live_halves(entries: DataFrame, groups: int) -> DataFrame:
    """(entry, left, right): the groups of minima, with their slots, that other entries have too; of either collection some."""
    halves = entries.select("entry", F.posexplode("halves").alias("slot", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("_n")).where("_n > 1").select("half")
    found = F.struct((F.col("slot") % groups).alias("slot"), "half")
    return halves.join(shared, "half").groupBy("entry").agg(
        F.collect_list(F.when(F.col("slot") < groups, found)).alias("left"),
        F.collect_list(F.when(F.col("slot") >= groups, found)).alias("right"),
    ).where((F.size("left") > 0) & (F.size("right") > 0))  # at most ``groups`` on either side


def table_keys(live: DataFrame, groups: int, turn: int) -> DataFrame:
    """(bucket, entry): the keys of the tables on a turn's diagonals. A table is a group of each collection."""
    apart = [(turn * DIAGONALS + i) % groups for i in range(DIAGONALS)]
    meets = F.filter("right", lambda r: F.pmod(r["slot"] - F.col("_a.slot"), F.lit(groups)).isin(apart))
    keys = live.select("entry", F.explode("left").alias("_a"), "right").select("entry", "_a", F.explode(meets).alias("_b"))
    return keys.select(F.xxhash64("_a.half", "_b.half").alias("bucket"), "entry")


def _long_sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = random_longs(n, _SEED)
        for rows in batches:
            sets = (np.array(found.as_py(), dtype=np.int64).view(np.uint64) for found in rows.column("shingles"))
            made = [_bytes(minima(found, functions)) for found in sets]
            yield with_columns(batch({"sketch": made}, {"sketch": pa.binary()}), rows, ("entry", "shingles", "root", "halves"))

    return run


def least_equal(n: int, similarity: float, deviations: float = 5) -> int:
    """So many of n bytes agree at least where the sets have the similarity, with some standard
    deviations allowed; other bytes agree by chance once in 256."""
    equal = similarity + (1 - similarity) / 256
    return math.floor(n * equal - deviations * math.sqrt(n * equal * (1 - equal)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


_PAIR = {"a": pa.int64(), "b": pa.int64(), "equal": pa.int32()}


def _agreeing(least: int):
    """The pairs of an entry and a hub whose minima agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            own, hub = _matrix(rows.column("sketch")), _matrix(rows.column("hub_sketch"))
            equal = (own == hub).sum(axis=1).astype(np.int32)
            found = np.flatnonzero(equal >= least)
            a, b = (rows.column(name).to_numpy()[found] for name in ("entry", "hub"))
            yield batch({"a": a, "b": b, "equal": equal[found]}, _PAIR)

    return run


def hub_candidates(members: DataFrame, turn: int) -> DataFrame:
    """(entry, hub): for each entry up to MET hubs, of other components, of its buckets.

    In the first turn a bucket's hubs are its entry with the most buckets, which is the
    middle of a group of copies, the smallest one, and one that is drawn; then all are drawn.
    Of all hubs of its buckets an entry is given the MET that it shares most buckets with.
    """
    draw = lambda i: F.struct(F.xxhash64("root", F.lit(turn * HUBS + i)), F.xxhash64("entry", F.lit(turn * HUBS + i)))
    orders = [draw(i) for i in range(HUBS)]
    ranked = members
    if not turn:
        orders[:2] = F.struct(-F.col("degree"), F.col("entry")), F.struct(F.col("entry"))
        ranked = members.join(members.groupBy("entry").agg(F.count("*").alias("degree")), "entry")
    hubs = ranked.groupBy("bucket").agg(
        F.array(*[F.min_by(F.struct("entry", "root"), order) for order in orders]).alias("_hubs")
    )
    others = F.transform(F.filter("_hubs", lambda h: h["root"] != F.col("root")), lambda h: h["entry"])
    met = members.join(hubs, "bucket").select("entry", F.array_distinct(others).alias("_hubs"))
    # At most HUBS for each of an entry's buckets.
    listed = met.groupBy("entry").agg(F.flatten(F.collect_list("_hubs")).alias("_hubs"))
    times = lambda h: F.size(F.filter("_hubs", lambda x: x == h))
    ranked = F.sort_array(F.transform(F.array_distinct("_hubs"), lambda h: F.struct((-times(h)).alias("n"), h.alias("hub"))))
    return listed.select("entry", F.explode(F.slice(ranked, 1, MET)).alias("_hub")).select("entry", F.col("_hub.hub").alias("hub"))


def _hub_pairs(members: DataFrame, sketches: DataFrame, turn: int, least: int) -> DataFrame:
    """(a, b): for each entry at most one hub of another component, the best of its candidates."""
    candidates = settle(hub_candidates(members, turn))
    times = candidates.groupBy("hub").agg(F.count("*").alias("_n"))
    facts = settle(times.join(sketches.select(F.col("entry").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub"))
    both = weighted_lookup(candidates.join(sketches, "entry"), facts, ["hub"], "_n")
    pairs = map_arrow(both, _agreeing(least), "a long, b long, equal int")
    best = settle(pairs.groupBy("a").agg(F.max(F.struct("equal", "b")).alias("_best")).select("a", F.col("_best.b").alias("b")))
    for frame in (candidates, facts):
        discard(frame)
    return best


def linked_with(own: np.ndarray, others: list[np.ndarray], least: int) -> np.ndarray:
    """Which of some sets overlap with one by ``least`` hundredths of their union; sets are sorted, none is empty."""
    every = np.concatenate(others)
    sizes = np.array([len(other) for other in others])
    hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both * 100 >= (len(own) + sizes - both) * least


def _apart(groups: int, short: int, least_short: int, least_long: int, hundredths: int):
    """The links that join components in each two blocks. A pair is looked at where it has
    the first group of minima that it shares, if it shares a table, its components are not
    joined yet and its minima agree often enough; links are confirmed on full sets."""

    def pairs(rows: list[tuple], key: int, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of a block with itself (``one``), or of two blocks."""
        *columns, parts = zip(*rows, strict=True)
        entries, roots, first, sketches, halves = (np.concatenate(column) for column in columns)
        sets = [found for part in parts for found in part]
        slot = int(np.flatnonzero(halves[0, :groups] == key)[0])
        left = np.arange(len(entries)) if one else np.flatnonzero(first)
        right = left if one else np.flatnonzero(~first)
        for place, i in enumerate(left.tolist()):
            others = right[place + 1 :] if one else right
            others = others[roots[others] != roots[i]]
            shared = halves[others] == halves[i]
            others = others[(shared[:, :groups].argmax(axis=1) == slot) & shared[:, groups:].any(axis=1)]
            others = others[(sketches[others, :short] == sketches[i, :short]).sum(axis=1) >= least_short]
            others = others[(sketches[others] == sketches[i]).sum(axis=1) >= least_long]
            if len(others):
                others = others[linked_with(sets[i], [sets[j] for j in others], hundredths)]
            if len(others):
                joined, one_each = np.unique(roots[others], return_index=True)
                others = others[one_each]
                roots[np.isin(roots, joined)] = roots[i]
                yield np.minimum(entries[others], entries[i]), np.maximum(entries[others], entries[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"a": pa.int64(), "b": pa.int64()}
        waiting: list[tuple] = []
        task = None

        def done() -> Iterator[pa.RecordBatch]:
            if waiting:
                for a, b in pairs(waiting, task[0], task[1] == task[2]):
                    yield batch({"a": a, "b": b}, types)

        for rows in batches:
            if not rows.num_rows:
                continue
            keys = np.stack([rows.column(name).to_numpy() for name in ("half", "low", "high")], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1), len(keys)]
            halves = rows.column("halves").flatten().to_numpy().reshape(len(keys), -1)
            sets = rows.column("shingles")
            bounds = sets.offsets.to_numpy()
            values = sets.values.to_numpy().view(np.uint64)
            columns = (
                rows.column("entry").to_numpy(), rows.column("root").to_numpy(),
                rows.column("block").to_numpy() == keys[:, 1], _matrix(rows.column("sketch")), halves,
                [values[start:end] for start, end in zip(bounds, bounds[1:])],
            )
            for start, end in zip(edges, edges[1:]):
                if (own := tuple(keys[start].tolist())) != task:
                    yield from done()
                    waiting, task = [], own
                waiting.append(tuple(column[start:end] for column in columns))
        yield from done()

    return run


def _block_links(members: DataFrame, groups: int, short: int, similarity: float, hundredths: int) -> DataFrame:
    """(a, b): links between entries (entry, root, sketch, halves, shingles, size) of different components
    that share a table, confirmed on full sets; of each two blocks those that join components.

    Entries meet by their groups of the first collection, of which each has few, and look
    in the task whether they share one of the second. The entries of a group are cut in
    blocks of about BLOCK, fewer where their sets are large, and each two blocks meet in a
    task of their own, so an entry is sent as often as its group has blocks.
    """
    by_half = members.select("entry", "root", "size", F.explode(F.slice("halves", 1, groups)).alias("half"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("_blocks")
    sizes = by_half.groupBy("half").agg(blocks, F.min("root").alias("_low"), F.max("root").alias("_high"))
    placed = by_half.join(sizes.where("_low <> _high").select("half", "_blocks"), "half")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("entry"), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    sent = placed.select("half", "entry", "block", other)
    sent = sent.select("*", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")).drop("_other")
    sent = sent.join(members.drop("size"), "entry").repartition("half", "low", "high").sortWithinPartitions("half", "low", "high")
    limits = least_equal(short, similarity), least_equal(WIDE, similarity)
    return map_arrow(sent, _apart(groups, short, *limits, hundredths), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs whose sets overlap by ``least`` hundredths of their union."""
    left = sets.select(F.col("entry").alias("a"), F.col("shingles").alias("_of_a"))
    right = sets.select(F.col("entry").alias("b"), F.col("shingles").alias("_of_b"))
    both = F.size(F.array_intersect("_of_a", "_of_b"))
    union = F.size("_of_a") + F.size("_of_b") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= union * least).select("a", "b")


def _with_roots(entries: DataFrame, found: DataFrame) -> DataFrame:
    return entries.join(found.withColumnRenamed("node", "entry"), "entry", "left").withColumn(
        "root", F.coalesce("root", "entry")
    )


def _open_members(rooted: DataFrame) -> DataFrame:
    """(bucket, entry, root) of the buckets that hold several components; of those with the same entries one."""
    same = F.bit_xor(F.xxhash64("entry")).alias("_one"), F.bit_xor(F.xxhash64("entry", F.lit(1))).alias("_other")
    several = rooted.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_n"), *same)
    several = several.where("_low <> _high").groupBy("_n", "_one", "_other").agg(F.min("bucket").alias("bucket"))
    return rooted.join(several.select("bucket"), "bucket").select("bucket", "entry", "root")


def _apart_entries(live: DataFrame, found: DataFrame) -> DataFrame:
    """(entry, root) of the entries that may share a table with another component: of either
    collection they have a group that several components have."""
    sides = [live.select("entry", F.lit(side).alias("side"), F.explode(f"{side}.half").alias("half")) for side in ("left", "right")]
    rooted = _with_roots(sides[0].unionByName(sides[1]), found)
    several = rooted.groupBy("half").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("half")
    both = rooted.join(several, "half").groupBy("entry").agg(F.min("root").alias("root"), F.min("side").alias("_low"), F.max("side").alias("_high"))
    return both.where("_low <> _high").select("entry", "root")


def _linked(entries: DataFrame, signed: DataFrame, words: int, similarity: float, groups: int, rows: int) -> DataFrame:
    """(node, root): the components of the entries' links."""
    hundredths = math.ceil(similarity * 100 - 1e-9)
    short = 2 * groups * rows
    live = settle(live_halves(entries, groups))
    involved = live.select("entry")
    sketches = settle(entries.select("entry", "sketch").join(involved, "entry"))
    texts = signed.select("_row", "text").join(involved.withColumnRenamed("entry", "_row"), "_row").select(F.col("_row").alias("entry"), "text")
    sets = settle(map_arrow(texts, _sets(words), "entry long, shingles array<long>"))
    found = None
    for turn in range(ROUNDS):
        keys = table_keys(live, groups, turn)
        members = settle(_open_members(_with_roots(keys, found) if found else keys.withColumn("root", F.col("entry"))))
        # Links that this misses are found in the end.
        pairs = _hub_pairs(members, sketches, turn, least_equal(short, similarity, 1))
        more = settle(_confirmed(pairs, sets, hundredths))
        for frame in (members, pairs):
            discard(frame)
        found = more_joined(found, more) if found else components(more)
        if not more.head(1) and turn:
            break
    left = _apart_entries(live, found)
    open_sets = sets.join(left.join(entries.select("entry", "halves"), "entry"), "entry").select("entry", "shingles", "root", "halves")
    wide = map_arrow(open_sets, _long_sketches(WIDE), "sketch binary, entry long, shingles array<long>, root long, halves array<long>")
    wide = settle(wide.withColumn("size", F.size("shingles")))
    for frame in (live, sets, sketches):
        discard(frame)
    more = settle(_block_links(wide, groups, short, similarity, hundredths))
    discard(wide)
    return more_joined(found, more) if more.head(1) else found


def _grouped(docs: DataFrame, carry: tuple[str, ...], words: int, similarity: float, groups: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their sets' keys, and of each key the best row of its component."""
    own = _names(carry)
    extra = "".join(f", {name} {docs.schema[c].dataType.simpleString()}" for c, name in own.items())
    more = [F.col(c).alias(name) for c, name in own.items()]
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    signed = numbered(map_arrow(chosen, _signed(words, groups, rows, tuple(own.values())), _SIGNATURES + extra))
    entries = settle(
        signed.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(
            F.min("_row").alias("entry"),
            F.min(_best_row()).alias("best"),
            F.count("*").alias("n_rows"),
            F.min_by("halves", "_row").alias("halves"),
            F.min_by("sketch", "_row").alias("sketch"),
        )
    )
    found = _linked(entries, signed, words, similarity, groups, rows)
    rooted = _with_roots(entries.select("entry", "set_key", "best", "n_rows"), found)
    lowest = rooted.groupBy("root").agg(F.min("best").alias("_best"))
    facts = settle(rooted.join(lowest, "root").select("set_key", "_best", "n_rows"))
    discard(entries)
    return signed, facts


def _names(carry: tuple[str, ...]) -> dict[str, str]:
    return {c: f"_carry{i}" for i, c in enumerate(carry) if c != "text"}


def _best_row() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("row"))


def near_groups(
    docs: DataFrame,
    *carry: str,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    groups: int = GROUPS,
    rows: int = MINIMA,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, stays, and the columns of ``carry``.

    A document's set holds its distinct runs of ``words`` words, A-Z lowered; with
    fewer words, all of them as one. Documents whose sets overlap by ``similarity`` of
    their union (in hundredths) are linked, and component_id is the smallest doc_id
    that links lead to. ``kept`` says that it is the row's own; ``stays`` is true for
    exactly one row of each component, also where rows repeat or ids are null (null
    comes last). Null and empty texts have no set and are linked with nothing; they
    stay. Texts of any length are taken whole; an empty table gives an empty result.
    """
    signed, facts = _grouped(docs, carry, words, similarity, groups, rows)
    rest = signed.drop("halves", "sketch", *([] if "text" in carry else ["text"]))
    placed = weighted_lookup(rest.where("n_shingles > 0"), facts, ["set_key"], "n_rows")
    alone = rest.where("n_shingles = 0").withColumn("_best", _best_row())
    return placed.unionByName(alone).select(
        "doc_id",
        "n_shingles",
        F.col("_best.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("_best.doc_id")).alias("kept"),
        (F.col("_row") == F.col("_best.row")).alias("stays"),
        *[F.col(_names(carry).get(c, c)).alias(c) for c in carry],
    )


def one_of_each(
    docs: DataFrame,
    *carry: str,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    groups: int = GROUPS,
    rows: int = MINIMA,
) -> DataFrame:
    """doc_id and the columns of ``carry`` of the rows that stay (see ``near_groups``).

    Only the numbers of the rows that go are joined, so texts move only where these
    are too many for a broadcast.
    """
    signed, facts = _grouped(docs, carry, words, similarity, groups, rows)
    keyed = signed.where("n_shingles > 0").select("_row", "set_key")
    placed = weighted_lookup(keyed, facts, ["set_key"], "n_rows")
    gone = settle(placed.where(F.col("_row") != F.col("_best.row")).select("_row"))
    left = signed.select("_row", "doc_id", *[_names(carry).get(c, c) for c in carry]).join(gone, "_row", "left_anti")
    return left.select("doc_id", *[F.col(_names(carry).get(c, c)).alias(c) for c in carry])


SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
), s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct([array_to_string(words[i : i + 4], ' ') for i in range(1, len(words) - 3)]) end as shingles
  from w
), e as (select doc_id, unnest(shingles) as shingle from s
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from e a join e b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), l as (
  select p.a, p.b from p join s x on x.doc_id = p.a join s y on y.doc_id = p.b
  where 100 * common >= 75 * (len(x.shingles) + len(y.shingles) - common)
), r(doc_id, reached) as (
  select doc_id, doc_id from s union select r.doc_id, l.b from r join l on l.a = r.reached
), c as (select doc_id, min(reached) as component_id from r group by 1)
select s.doc_id, len(s.shingles)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept,
       s.doc_id = c.component_id as stays
from s join c using (doc_id)
"""
