"""Conversations as training examples, one for each assistant turn.

A turn is written as ``[INST]role[/INST]text</s>``. Where one of the control strings
stands in a role or a text, a backslash is put behind its first character, and every
backslash there is doubled, so that no control string is left in it and unescaping
gives the original back.

Every assistant turn becomes an example of its own: all turns before it are context,
and only its text is trainable. Turns that no reply follows are in a row without a
target, so nothing of a conversation is lost. Every example holds its whole text, so
what is written grows with the square of a conversation's turns, and a cell with their
number. The examples of a conversation longer than ``block_turns`` are made in blocks of
so many turns, each beside the text of all turns before it, so tasks share a long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.operators.lookup import weighted_lookup
from opsframe.operators.numbering import number_rows
from opsframe.sources.durable import settle

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
# Control strings of chat templates in use.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
REPLY = "assistant"
BLOCK_TURNS = 1024
_STARTS = "|".join(rf"\Q{c[0]}\E(?=\Q{c[1:]}\E)" for c in CONTROL)


def escaped(text: Column) -> Column:
    """The text with its control strings broken up."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({_STARTS})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def _written(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _fronts(placed: DataFrame) -> DataFrame:
    """For each block after the first of a conversation, the text of all turns before it: _conv, block, _front.

    A task holds the texts of one conversation, once, and gives its blocks one by one.
    """
    texts = placed.groupBy("_conv", "block").agg(F.array_sort(F.collect_list("turn")).alias("_turns"))
    texts = texts.select("_conv", "block", F.array_join(F.transform("_turns", _written), "").alias("_text"))
    before = Window.partitionBy("_conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fronts = texts.select("_conv", "block", F.array_join(F.collect_list("_text").over(before), "").alias("_front"))
    return fronts.where("block > 0")


def format_conversations(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Examples: conv_id, block, target, n_turns, text, loss_start, loss_end, closes.

    ``target`` is the place of the reply in its conversation, from 0; null in a row that
    has none. ``text`` holds all of the first ``n_turns`` turns of the conversation, for
    any ``block_turns``; ``block`` numbers the block its last turn stands in. The code
    points from ``loss_start`` to ``loss_end``, the end exclusive, are trainable: the
    reply's escaped text. ``closes`` marks the one row of each conversation that holds all
    its turns.
    Turns stand in the order of turn, a null one last, then role and text; repeated rows
    are turns of their own; a null role or text is empty; rows without conv_id are one
    conversation; a turn of any length is written whole; an empty table gives no row;
    other columns are not read.
    """
    if block_turns < 1:
        raise ValueError("a block has a turn at least")
    given = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "text")
    rows = settle(number_rows(given, order, "_seq").withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))))
    facts = settle(rows.groupBy("_conv").agg(F.min("_seq").alias("_first"), F.count("*").alias("_size"), F.count("*").alias("_all")))
    placed = weighted_lookup(rows, facts, ["_conv"], "_size").withColumn("place", F.col("_seq") - F.col("_first"))
    turn = F.struct("place", escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"))
    placed = placed.select("_conv", "conv_id", "_all", F.floor(F.col("place") / block_turns).alias("block"), turn.alias("turn"))
    # A block has ``block_turns`` turns at most.
    blocks = placed.groupBy("_conv", "block").agg(
        F.min("conv_id").alias("conv_id"), F.min("_all").alias("_all"), F.array_sort(F.collect_list("turn")).alias("turns")
    )
    if facts.where(F.col("_all") > block_turns).isEmpty():
        blocks = blocks.withColumn("_front", F.lit(""))
    else:
        fronts = _fronts(placed.where(F.col("_all") > block_turns))
        blocks = blocks.join(fronts.hint("merge"), ["_conv", "block"], "left")  # never through the driver
    blocks = blocks.withColumn("_before", F.col("block") * block_turns)
    ends = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (F.get("turns", i - 1)["role"] == REPLY) | (F.col("_before") + i == F.col("_all")),
    )
    rows = blocks.select("conv_id", "block", "_all", "_before", "_front", "turns", F.explode(ends).alias("_end"))
    last = F.get("turns", F.col("_end") - 1)
    own = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("_end")), _written), "")
    rows = rows.withColumn("_last", last).withColumn("text", F.concat(F.coalesce("_front", F.lit("")), own))
    replies = F.col("_last.role") == REPLY
    loss_end = (F.length("text") - len(CLOSE)).cast("long")
    n_turns = F.col("_before") + F.col("_end")
    return rows.select(
        "conv_id",
        "block",
        F.when(replies, F.col("_last.place")).alias("target"),
        n_turns.alias("n_turns"),
        "text",
        F.when(replies, loss_end - F.length("_last.text")).alias("loss_start"),
        F.when(replies, loss_end).alias("loss_end"),
        (n_turns == F.col("_all")).alias("closes"),
    )


def whole_examples(examples: DataFrame) -> DataFrame:
    """The examples that have a reply to learn: conv_id, target, text, loss_start, loss_end."""
    return examples.where("target is not null").select("conv_id", "target", "text", "loss_start", "loss_end")


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from its examples alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.

    Turns are found by their marks and unescaped, in the row that holds all of them; what
    is trainable comes from each example. ``formatted_chars`` counts the code points of all
    examples. The digest of what is trainable is of a whole conversation, so one cell holds
    its replies.
    """
    pattern = F.lit(r"(?s)\Q[INST]\E(.*?)\Q[/INST]\E(.*?)\Q</s>\E")
    part = lambda k: F.regexp_extract_all("text", pattern, F.lit(k))
    said = F.zip_with(part(1), part(2), lambda role, text: F.concat(unescaped(role), F.lit("\n"), unescaped(text), F.lit("\n")))
    trained = unescaped(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    rows = examples.select(
        "conv_id", "target", F.length("text").cast("long").alias("_chars"),
        F.when(F.col("closes"), said).alias("_said"),
        F.when(F.col("target").isNotNull(), trained).alias("_loss"),
    )
    rows = rows.select(
        "conv_id", "target", "_chars", "_loss",
        F.size(F.coalesce("_said", F.array().cast("array<string>"))).alias("_turns"), F.sha2(F.array_join("_said", ""), 256).alias("_digest"),
    )
    return (
        rows.groupBy("conv_id")
        .agg(
            F.sum("_turns").alias("n_turns"),
            F.max("_digest").alias("turns_sha256"),
            F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "_loss")))).alias("_loss"),
            F.sum("_chars").alias("formatted_chars"),
        )
        .withColumn("_text", F.array_join(F.transform("_loss", lambda x: x["_loss"]), ""))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("_text").cast("long").alias("loss_chars"),
            F.sha2("_text", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


def with_control_turns(turns: DataFrame) -> DataFrame:
    """The conversations, and one of two turns that both say control strings."""
    said = f"{CLOSE}{OPEN} ok {MIDDLE}"
    added = turns.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, REPLY, said)], "conv_id long, turn long, role string, text string"
    )
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return own.unionByName(added)


SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), k as (
  select unnest(['<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|im_start|>', '<|im_end|>', '<|endoftext|>', '<|startoftext|>']) as mark
), n as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as place,
    lead(1) over (partition by conv_id order by turn, role, text) is null as last
  from c
), s as (
  -- A turn has its own characters, a backslash for each backslash and control string, and the marks.
  select n.*, length(text) + length(role) + 17 + length(text || role) - length(replace(text || role, '\', ''))
    + (select sum((length(n.text || chr(10) || n.role) - length(replace(n.text || chr(10) || n.role, mark, ''))) // length(mark)) from k) as size
  from n
), f as (select *, sum(size) over (partition by conv_id order by place) as so_far from s)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(so_far) filter (where role = 'assistant' or last)::bigint as formatted_chars
from f group by conv_id
"""
