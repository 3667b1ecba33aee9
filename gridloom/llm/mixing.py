"""Mixing sources to target weights by a low-discrepancy schedule (problem 9).

A mix is cut into slots of ``block_tokens`` tokens. The slots' order runs through the points of a
van der Corput sequence, taken in integers over a whole period, and each point belongs to the source
under it on the stairs of cumulative slot counts, that is, of cumulative weights: each source gets exactly its slots, and every
stretch of the mix holds each source close to its share. The k-th slot of a source takes the k-th
block of its stream: its documents in hashed order, again and again up to the repeat cap, cut
into blocks of equal tokens, a document running over into the next block where it does not fit.

Weights are first the targets: their slots tell which sources run dry. The mix itself is scheduled
anew with what each source can give, so a short source is spread over the whole mix and no slot
stays empty. All running sums have two levels (shards, then rows of a shard), so a source holding a
third of all rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.analytics import small
from gridloom.storage import materialize

BLOCK_TOKENS = 2048
SHARD_DOCUMENTS = 50_000


def _running(df: DataFrame, keys: list[str], shard: Column, order: list[str], amount: Column, name: str) -> DataFrame:
    """Add the exclusive running sum of ``amount`` per ``keys`` in order of shard, then ``order``."""
    cut = df.withColumn("_shard", shard).withColumn("_amount", amount)
    sums = cut.groupBy(*keys, "_shard").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_shard", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(offsets, [*keys, "_shard"])
    return joined.withColumn(name, F.col("_offset") + F.coalesce(F.sum("_amount").over(inside), F.lit(0))).drop("_shard", "_amount", "_offset")


def plan(counts: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a target: what is wanted, what can be had, and both in slots.

    wanted_tokens is target_share x size_factor x the tokens of all documents, those without a
    source and of sources outside the mix included; available_tokens the source's tokens times
    max_repeats, 0 for an absent source; given_tokens the lesser of both, in whole tokens.
    """
    per_source = counts.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    total = per_source.agg(F.coalesce(F.sum("source_tokens"), F.lit(0))).scalar()
    rows = targets.select("mix_name", "size_factor", "source", "target_share", "max_repeats").join(per_source, "source", "left").withColumn("all_tokens", total)
    rows = rows.select(
        "mix_name",
        "source",
        "target_share",
        "max_repeats",
        F.greatest(F.coalesce(F.col("target_share") * F.col("size_factor") * F.col("all_tokens"), F.lit(0.0)), F.lit(0.0)).alias("wanted_tokens"),
        F.greatest(F.coalesce("source_tokens", F.lit(0)) * F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("available_tokens"),
        F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
    )
    given = F.least(F.ceil("wanted_tokens"), F.col("available_tokens"))
    return rows.select("*", given.alias("given_tokens"), F.ceil(F.col("wanted_tokens") / block_tokens).alias("wanted_slots"), F.ceil(given / block_tokens).cast("bigint").alias("given_slots"))


def schedule(planned: DataFrame, slots: str = "given_slots", chunk: int = 16_384) -> DataFrame:
    """(mix_name, source, slot, rank): every slot of every mix and its place among its source's slots.

    ``slots`` names the column of ``planned`` with each source's number of slots. A prefix of the
    schedule holds each source's share but for a few slots (about a third of log2 of all slots).
    """
    n, mix = F.col(slots).cast("bigint"), Window.partitionBy("mix_name")
    stairs = planned.where(n > 0).select(
        "mix_name", "source", n.alias("n"), (F.sum(n).over(mix.orderBy("source")) - n).alias("lo"), F.length(F.bin(F.sum(n).over(mix) - 1)).alias("bits")
    )
    starts = stairs.withColumn("start", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("n") - 1, F.lit(chunk).cast("bigint"))))
    stop = F.least(F.col("start") + chunk, F.col("lo") + F.col("n")) - 1
    points = starts.repartition("mix_name", "source", "start").withColumn("point", F.explode(F.sequence("start", stop)))
    # A point's turn in the sequence is its bits read backwards, so sources find their own turns.
    turn = F.conv(F.reverse(F.call_function("lpad", F.bin("point"), F.col("bits"), F.lit("0"))), 2, 10).cast("bigint")
    owned = points.select("mix_name", "source", turn.alias("turn"))
    shard, one = F.call_function("div", F.col("turn"), F.lit(chunk)), F.lit(1).cast("bigint")
    ranked = _running(owned, ["mix_name", "source"], shard, ["turn"], one, "rank")
    return _running(ranked, ["mix_name"], shard, ["turn"], one, "slot").drop("turn")


def streams(counts: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, at): each source's documents in hashed order and where they start.

    Shards are as many as keep each below about ``SHARD_DOCUMENTS`` documents.
    """
    some = counts.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    shards = max(1, -(-counts.count() // SHARD_DOCUMENTS))
    return _running(some, ["source"], F.pmod("h", F.lit(shards)), ["h", "doc_id", "n_tokens"], F.col("n_tokens"), "at").drop("h")


def blocks(counts: DataFrame, planned: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_name, source, rank, doc_id, repeat_no, token_from, token_to): which tokens of which documents fill a source's blocks.

    A source gives documents until its given_tokens are reached: no document more than max_repeats
    times, and of the last one only what is still wanted. A block holds exactly ``block_tokens`` tokens, a
    source's last one what is left.
    """
    giving = planned.where("given_tokens > 0").select("mix_name", "source", "given_tokens", "max_repeats", "source_tokens")
    copies = streams(counts).join(small(giving), "source").where(F.col("at") < F.col("given_tokens"))
    last = F.least(F.col("max_repeats") - 1, F.call_function("div", F.col("given_tokens") - F.col("at") - 1, F.col("source_tokens"))).cast("int")
    copies = copies.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), last)))
    copies = copies.withColumn("start", F.col("at") + F.col("repeat_no") * F.col("source_tokens"))
    copies = copies.withColumn("stop", F.least(F.col("start") + F.col("n_tokens"), "given_tokens"))
    div = lambda c: F.call_function("div", c, F.lit(block_tokens))
    pieces = copies.withColumn("rank", F.explode(F.sequence(div(F.col("start")), div(F.col("stop") - 1))))
    return pieces.select(
        "mix_name",
        "source",
        "rank",
        "doc_id",
        F.col("repeat_no").cast("bigint").alias("repeat_no"),
        (F.greatest(F.col("start"), F.col("rank") * block_tokens) - F.col("start")).alias("token_from"),
        (F.least(F.col("stop"), (F.col("rank") + 1) * block_tokens) - F.col("start")).alias("token_to"),
    )


def mixture(counts: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_name, slot, source, doc_id, repeat_no, token_from, token_to): the documents of each mix in slot order.

    Tokens [token_from, token_to) of a document's encoding lie in the slot. Slots follow the shares
    that can be reached: a source that has less than its target is spread thinner over the whole
    mix. Documents without tokens or source are in no mix; an empty table of documents or targets
    gives no rows. There may be any number of targets.
    """
    planned = materialize(plan(counts, targets, block_tokens), "mixplan")
    slots = schedule(planned, "given_slots")
    return blocks(counts, planned, block_tokens).join(slots, ["mix_name", "source", "rank"]).select("mix_name", "slot", "source", "doc_id", "repeat_no", "token_from", "token_to")


def target_slots(counts: DataFrame, planned: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_name, source, rank, room, filled): the slots the targets ask for, and the tokens the sources' blocks put in them."""
    drawn = blocks(counts, planned, block_tokens).groupBy("mix_name", "source", "rank").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("filled"))
    wanted = planned.select("mix_name", "source", "wanted_tokens")
    slots = schedule(planned, "wanted_slots").join(small(wanted), ["mix_name", "source"])
    room = F.least(F.lit(block_tokens).cast("double"), F.col("wanted_tokens") - F.col("rank") * block_tokens)
    return slots.join(drawn, ["mix_name", "source", "rank"], "left").select("mix_name", "source", "rank", room.alias("room"), F.coalesce("filled", F.lit(0)).alias("filled"))


def shares(counts: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_name, source, target_share, share_reached, wanted_tokens, drawn_tokens, available_tokens, is_short).

    Read off the slots the targets ask for: what was drawn of a source is what fills its slots, and
    it is short if one of them stays unfilled. As blocks fill in order and the last slot
    has room for just the rest wanted, that is so exactly if fewer tokens are available than wanted. A
    target of no tokens has no slot and is not short; nothing reached of a mix gives null shares.
    """
    planned = materialize(plan(counts, targets, block_tokens), "mixplan")
    seen = target_slots(counts, planned, block_tokens).groupBy("mix_name", "source").agg(F.sum("filled").alias("drawn"), F.max(F.col("filled") < F.col("room")).alias("unfilled"))
    rows = planned.join(seen, ["mix_name", "source"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    mix = Window.partitionBy("mix_name")
    return rows.select(
        "mix_name",
        "source",
        "target_share",
        (F.col("drawn") / F.nullif(F.sum("drawn").over(mix), F.lit(0))).alias("share_reached"),
        "wanted_tokens",
        F.col("drawn").alias("drawn_tokens"),
        "available_tokens",
        F.coalesce("unfilled", F.lit(False)).alias("is_short"),
    )
