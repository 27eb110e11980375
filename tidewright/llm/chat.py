"""Chat formatting of preferences: shared turns once as the prompt, then a completion of either side with its masks.

Only DataFrame functions. Pairs come as a table of ids. Without one they are made from the conversations: those that share their
first user turn answer the same request, and each is chosen over the one in which the assistant says least, so
a request that very many share gives as many pairs as conversations. As an option the ids 2k and 2k + 1 make a pair as well, in
which the side where the assistant says more is chosen, the even one where both say as much. The longest common beginning
of both sides, turn by turn with role and text, is rendered once; the turns after it are the completions.

A completion is a list of pieces, each with a flag that says whether it is trained on: what the assistant says is, with
its end mark; role marks and the words of others are not.

Turns are ordered by turn, then role and text; a null turn comes first and null roles or texts count as empty. Repeated rows
are turns that are said again. A pair with an id that has no turns is left out; a pair that repeats is formatted once; equal
conversations give empty completions, marked identical. Rows with a null conv_id are left out. An empty table gives no pairs. A conversation's
turns become one row, as its rendering is one text, so it has to fit in memory. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import materialise

# The marks of the rendered chat.
BEGIN, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def opened(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit("\n"))


def rendered(turns: Column) -> Column:
    """Turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(opened(t.role), t.text, F.lit(END + "\n"))), "")


def masked(turns: Column) -> Column:
    """Turns as pieces (text, train): the head of a turn is never trained on, its text only where the assistant speaks."""
    two = F.transform(
        turns,
        lambda t: F.array(
            F.struct(opened(t.role).alias("text"), F.lit(False).alias("train")),
            F.struct(F.concat(t.text, F.lit(END + "\n")).alias("text"), (t.role == TRAINED_ROLE).alias("train")),
        ),
    )
    return F.flatten(two)


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order; request: a digest of the first user turn; said: characters by the assistant."""
    clean = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.withColumn("turns", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))))
    asked = F.filter("turns", lambda t: t.role == "user")
    said = F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + F.when(t.role == TRAINED_ROLE, F.length(t.text)).otherwise(0))
    return whole.select("conv_id", "turns", F.sha2(F.get(asked, F.lit(0)).text.cast("binary"), 256).alias("request"), said.alias("said"))


def pairs_by_request(whole: DataFrame) -> DataFrame:
    """chosen_id, rejected_id: in each request all over the one in which the assistant says least, then the smallest id.

    The minimum combines before the shuffle, and the join back can split a hot request.
    """
    asked = whole.filter("request is not null").select("conv_id", "request", "said")
    worst = asked.groupBy("request").agg(F.min(F.struct("said", "conv_id")).alias("worst"), F.count("*").alias("n")).filter("n > 1")
    worst = materialise(worst.select("request", F.col("worst.conv_id").alias("rejected_id")), "chat-worst")
    return asked.join(worst, "request").filter("conv_id <> rejected_id").select(F.col("conv_id").alias("chosen_id"), "rejected_id")


def neighbouring_pairs(whole: DataFrame) -> DataFrame:
    """chosen_id, rejected_id: ids 2k and 2k + 1, where both have turns."""
    sides = whole.groupBy(F.floor(F.col("conv_id") / 2).alias("k")).agg(
        F.max(F.struct("said", (-F.col("conv_id")).alias("back"))).alias("best"), F.min(F.struct("said", (-F.col("conv_id")).alias("back"))).alias("worst"), F.count("*").alias("n")
    )
    return sides.filter("n > 1").select((-F.col("best.back")).alias("chosen_id"), (-F.col("worst.back")).alias("rejected_id"))


def preferences(turns: DataFrame, pairs: DataFrame | None = None, neighbours: bool = False) -> DataFrame:
    """One row per pair: chosen_id, rejected_id, n_common, prompt, chosen and rejected as texts and as masked pieces, identical.

    pairs: chosen_id and rejected_id; without it, conversations with the same request. neighbours: also ids 2k and 2k + 1, whatever they ask.
    """
    whole = materialise(conversations_of(turns), "chat-turns")
    if pairs is None:
        pairs = pairs_by_request(whole)
        if neighbours:
            pairs = pairs.union(neighbouring_pairs(whole))
    pairs = materialise(pairs.select("chosen_id", "rejected_id").distinct(), "chat-pairs")
    good, bad = (whole.select(F.col("conv_id").alias(f"{side}_id"), F.col("turns").alias(name)) for side, name in (("chosen", "turns"), ("rejected", "rejected_turns")))
    # Both sides of each join come straight from a shuffle, so an id that very many pairs name can be split.
    pairs = materialise(pairs.join(good, "chosen_id"), "chat-chosen").join(bad, "rejected_id").withColumnRenamed("chosen_id", "conv_id")
    shorter = F.least(F.size("turns"), F.size("rejected_turns"))
    differ = F.array_position(F.transform(F.slice(F.zip_with("turns", "rejected_turns", lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(1), F.greatest(shorter, F.lit(1))), lambda same: same), False)
    pairs = pairs.withColumn("n_common", F.when(differ > 0, differ - 1).otherwise(shorter.cast("bigint")).cast("int"))
    after = lambda side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    pairs = pairs.select("conv_id", "rejected_id", "n_common", F.slice("turns", F.lit(1), F.col("n_common")).alias("common"), after("turns").alias("good"), after("rejected_turns").alias("bad"))
    return pairs.select(
        F.col("conv_id").alias("chosen_id"),
        "rejected_id",
        F.col("n_common").cast("bigint").alias("n_common"),
        rendered(F.col("common")).alias("prompt"),
        rendered(F.col("good")).alias("chosen"),
        rendered(F.col("bad")).alias("rejected"),
        masked(F.col("good")).alias("chosen_pieces"),
        masked(F.col("bad")).alias("rejected_pieces"),
        ((F.size("good") == 0) & (F.size("bad") == 0)).alias("identical"),
    )
