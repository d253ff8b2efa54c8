"""Chat formatting: every participant's view of a dialogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns that one rendered row spans.
BLOCK = 64
#: Stands for the block of null turns in joins; no turn has it.
NO_TURN = -(1 << 62)
HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"


def rotate_perspectives(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, perspective, block, n_turns, dialogue, spans): the dialogue as each participant would be trained on it.

    turns has conv_id, turn, role and text; other columns are ignored. For each distinct role of a conversation the
    messages are rendered in order of turn (null turns first; ties by role, then text), that role as assistant, any
    other as a user with its name. spans lists the [start, end) character ranges of the assistant's contents with their
    end marks, the ones a loss mask keeps. Null roles are named unknown and null or empty texts are empty messages.
    Rows that repeat all four columns are one message. Rows without conv_id are no conversation and are left out.

    A row covers the turns of one block (turn / block, rounded down; null turns are a block of their own, null), so a
    conversation of any length, and of texts of any length, stays in rows of so many turns. Dialogues of the blocks
    follow each other, null first; spans count from the start of the row's own. Texts are shuffled once, by (conv_id,
    block); roles are gathered per conversation without them. An empty table gives none.
    """
    base = turns.where("conv_id IS NOT NULL").select(
        "conv_id", F.expr(f"coalesce((turn - pmod(turn, {block})) div {block}, {NO_TURN}L)").alias("block"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    roles = base.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    keys = base.select("conv_id", "block").distinct().join(roles, "conv_id")
    messages = base.groupBy("conv_id", "block").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("messages"))
    views = messages.join(keys, ["conv_id", "block"]).select("conv_id", F.explode("roles").alias("perspective"), "block", "messages")
    mine = f"named_struct('own', true, 'head', '{HEAD}assistant\\n', 'body', concat(x.text, '{TAIL}'))".replace("\n", "\\n")
    other = f"named_struct('own', false, 'head', concat('{HEAD}user name=', x.role, '\\n'), 'body', concat(x.text, '{TAIL}'))".replace("\n", "\\n")
    parts = views.withColumn("parts", F.expr(f"transform(messages, x -> if(x.role = perspective, {mine}, {other}))"))
    walk = """
        aggregate(parts, named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, end: bigint>>)),
            (s, x) -> named_struct('at', s.at + length(x.head) + length(x.body), 'spans',
                if(x.own, array_append(s.spans, named_struct('start', s.at + length(x.head), 'end', s.at + length(x.head) + length(x.body))), s.spans)),
            s -> s.spans)
    """
    dialogue = F.array_join(F.expr("transform(parts, x -> concat(x.head, x.body))"), "")
    return parts.select("conv_id", "perspective", F.nullif(F.col("block"), F.lit(NO_TURN)).alias("block"), F.size("messages").cast("long").alias("n_turns"), dialogue.alias("dialogue"), F.expr(walk).alias("spans"))
