"""Preference formatting of chosen and rejected conversations, in DataFrame functions.

Conversations are compared turn by turn; the longest common prefix (same role and text at every place) is rendered
once as the prompt, without loss. What follows is rendered for each side as its completion, where the loss
mask is set on the assistant's turns. A turn renders as ``<|im_start|>role`` newline, text,
``<|im_end|>`` newline; those marks inside a role or text get a space after ``<`` so that no text can open a turn.

The result has a row for each rendered turn (pair_id, segment, turn, part, role, rendered, loss), so a
conversation of any length is never gathered into one row or task: the end of the prefix is the smallest place where the
sides differ, a partial aggregate. ``assembled`` joins the turns of short conversations into one row a pair.

The turn number is the place in a conversation; rows that repeat a turn number follow by role and text as
parts 0, 1, ... A null role or text counts as empty; a null turn comes first. Rows with a null pair take no part. A pair
that has one side only has an empty prefix: all its turns are completion. Two equal sides are all
prompt. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.operators.positional import with_position

TRAINED = "assistant"


def plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|im_start|>"), F.lit("< |im_start|>")), F.lit("<|im_end|>"), F.lit("< |im_end|>"))


def rendered() -> Column:
    return F.concat(F.lit("<|im_start|>"), plain(F.col("role")), F.lit("\n"), plain(F.col("text")), F.lit("<|im_end|>\n"))


def turns(side: DataFrame) -> DataFrame:
    """(pair_id, turn, part, role, text) of one side's rows. Rows that repeat a turn number, however many, are numbered
    by range partitioning."""
    side = side.where("pair_id is not null").select(
        F.struct("pair_id", "turn").alias("place"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = side.groupBy("place").count().where("count > 1").select("place")
    once = side.join(repeated, "place", "left_anti").withColumn("part", F.lit(0))
    more = with_position(side.join(repeated, "place", "left_semi"), ["place"], ["role", "text"], "part").withColumn("part", F.col("part").cast("int"))
    return once.unionByName(more).select("place.pair_id", "place.turn", "part", "role", "text")


def preference_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both sides are (pair_id, turn, role, text); the result is described above."""
    names = ("role", "text")
    place = [F.coalesce(F.col("c.pair_id"), F.col("r.pair_id")).alias("pair_id"), F.coalesce(F.col("c.turn"), F.col("r.turn")).alias("turn"),
             F.coalesce(F.col("c.part"), F.col("r.part")).alias("part")]
    c, r = turns(chosen).alias("c"), turns(rejected).alias("r")
    both = c.join(r, (F.col("c.pair_id") == F.col("r.pair_id")) & F.col("c.turn").eqNullSafe(F.col("r.turn"))
                  & (F.col("c.part") == F.col("r.part")), "full").select(
        *place, *[F.col(f"c.{n}").alias(f"c_{n}") for n in names], *[F.col(f"r.{n}").alias(f"r_{n}") for n in names])
    at = F.struct(F.col("turn").isNotNull().alias("k"), "turn", "part")
    same = F.col("c_role").eqNullSafe(F.col("r_role")) & F.col("c_text").eqNullSafe(F.col("r_text"))
    split = both.where(~same).groupBy("pair_id").agg(F.min(at).alias("split"))
    cut = both.join(split, "pair_id", "left").withColumn("shared", F.col("split").isNull() | (at < F.col("split")))

    # one pass makes all three segments: a place yields a prompt turn, or a turn of each side that has it
    sides = F.when(F.col("shared"), F.array(F.struct(F.lit("prompt").alias("segment"), F.col("c_role").alias("role"), F.col("c_text").alias("text")))) \
        .otherwise(F.array(F.struct(F.lit("chosen").alias("segment"), F.col("c_role").alias("role"), F.col("c_text").alias("text")),
                           F.struct(F.lit("rejected").alias("segment"), F.col("r_role").alias("role"), F.col("r_text").alias("text"))))
    return (cut.select("pair_id", "turn", "part", F.inline(sides)).where("role is not null")
            .select("pair_id", "segment", "turn", "part", "role", rendered().alias("rendered"),
                    ((F.col("segment") != "prompt") & (F.col("role") == TRAINED)).alias("loss")))


def assembled(rows: DataFrame) -> DataFrame:
    """One row a pair: prompt, chosen, rejected and, for both completions, the code point ranges under loss.
    For conversations that fit a training example; longer ones are better read turn by turn."""
    order = F.struct(F.col("turn").isNotNull().alias("k"), "turn", "part", "rendered", "loss")
    joined = rows.groupBy("pair_id").pivot("segment", ["prompt", "chosen", "rejected"]).agg(F.array_sort(F.collect_list(order)))

    def text(name: str) -> Column:
        return F.concat_ws("", F.transform(F.col(name), lambda t: t["rendered"])).alias(name)

    def mask(name: str) -> Column:
        return F.expr(f"""aggregate(coalesce({name}, array()), named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>)),
            (a, t) -> named_struct('at', a.at + length(t.rendered), 'out', if(t.loss,
                concat(a.out, array(named_struct('start', a.at, 'end', a.at + length(t.rendered)))), a.out)), a -> a.out)""").alias(f"{name}_loss")

    return joined.select("pair_id", text("prompt"), text("chosen"), mask("chosen"), text("rejected"), mask("rejected"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Preference turns of the table's conversations, paired by id: 2k is chosen over 2k + 1."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    pair = F.shiftright("conv_id", 1).alias("pair_id")
    even = F.pmod("conv_id", F.lit(2)) == 0
    side = lambda keep: rows.where(keep).select(pair, "turn", "role", "text")
    return preference_turns(side(even), side(~even))


def pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, chosen_loss, rejected, rejected_loss): the training examples themselves, one row a pair. The ranges
    under loss are code points of their completion, ``start:end`` comma-joined."""
    rows = assembled(neighbours(conversations))
    ranges = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return rows.withColumn("chosen_loss", ranges("chosen_loss")).withColumn("rejected_loss", ranges("rejected_loss"))


def _sql(side: str) -> str:
    even = "=" if side == "c" else "<>"
    return f"""(select conv_id // 2 as pair_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id, turn order by coalesce(role, ''), coalesce(text, '')) - 1 as part
        from conversations where conv_id % 2 {even} 0)"""


ORACLE_SQL = f"""
with c as {_sql("c")}, r as {_sql("r")},
split as (
    select pair_id, min(turn * 1000000 + part) as at from (
        select coalesce(c.pair_id, r.pair_id) as pair_id, coalesce(c.turn, r.turn) as turn, coalesce(c.part, r.part) as part
        from c full join r on c.pair_id = r.pair_id and c.turn = r.turn and c.part = r.part
        where c.role is distinct from r.role or c.text is distinct from r.text) group by pair_id),
cut as (
    select 'chosen' as side, c.*, coalesce(c.turn * 1000000 + c.part < s.at, true) as shared from c left join split s using (pair_id)
    union all
    select 'rejected', r.*, coalesce(r.turn * 1000000 + r.part < s.at, true) from r left join split s using (pair_id))
select pair_id, case when shared then 'prompt' else side end as segment, turn, cast(part as integer) as part, role,
    '<|im_start|>' || replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
    || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) as rendered,
    not shared and role = 'assistant' as loss
from cut where not (shared and side = 'rejected')
"""

PAIRS_SQL = f"""
with turns as ({ORACLE_SQL}),
placed as (
    select *, coalesce(sum(length(rendered)) over (partition by pair_id, segment order by turn, part rows between unbounded preceding and 1 preceding), 0) as begun
    from turns),
sides as (
    select pair_id, segment, string_agg(rendered, '' order by turn, part) as text,
        coalesce(string_agg(begun || ':' || (begun + length(rendered)), ',' order by turn, part) filter (where loss), '') as loss
    from placed group by pair_id, segment)
select pair_id, coalesce(max(text) filter (where segment = 'prompt'), '') as prompt, coalesce(max(text) filter (where segment = 'chosen'), '') as chosen,
    coalesce(max(loss) filter (where segment = 'chosen'), '') as chosen_loss, coalesce(max(text) filter (where segment = 'rejected'), '') as rejected,
    coalesce(max(loss) filter (where segment = 'rejected'), '') as rejected_loss
from sides group by pair_id
"""
