"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation several times, each time with a few more turns. Every conversation gets a
rolling hash at each turn, over the position, role and text of all turns so far. A conversation whose last hash
is another, longer one's hash at the same turn is a snapshot of it; an anti-join drops these, and of equal
conversations the one of the least id stays. What is left is maximal and is rendered.

The rolling hash is a running sum of hashes of (position, role, text) modulo 2**47, two of them: equal prefixes
have equal sums. Positions and sums are prefix sums over range partitions, so a conversation may be of any length
and spread over many tasks; only its rendered row is whole. Prefixes are made distinct by an aggregate that
combines map-side before the anti-join, so a first turn that a third of all conversations share is one row.

Defined results: rows whose conversation or turn is null belong to no conversation and are left out; a row that
is repeated in all of conversation, turn, role and text counts once; rows of one turn that differ follow each
other by role and text; null roles and texts are empty; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.llm.session import stored
from bitcurve.operators.ranking import group_prefix_sums

TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"
_BITS = (1 << 47) - 1
_LOW = (1 << 23) - 1


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct turns with their place in the conversation and its rolling hashes."""
    rows = (
        turns.select(
            F.col(conv).cast("long").alias("conv_id"),
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        )
        .filter("conv_id IS NOT NULL AND turn IS NOT NULL")
        .distinct()
    )
    placed = group_prefix_sums(rows, ["conv_id"], ["turn", "role", "text"], {"place": "bigint(1)"})
    # Halves of the hashes are summed apart: a sum of numbers below 2**24 has room for 2**39 turns.
    value = {name: f"(xxhash64({seed}, place, role, text) & {_BITS}L)" for seed, name in ((1, "h1"), (2, "h2"))}
    halves = {f"{n}_high": f"shiftright({v}, 23)" for n, v in value.items()} | {f"{n}_low": f"{v} & {_LOW}L" for n, v in value.items()}
    summed = group_prefix_sums(placed.select("conv_id", "place", "role", "text"), ["conv_id"], ["place"], halves)
    sums = [F.expr(f"(shiftleft({n}_high & {_BITS >> 23}L, 23) + {n}_low) & {_BITS}L AS {n}") for n in value]
    return summed.select("conv_id", "place", "role", "text", *sums)


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one continues; one of equal ones. ``prefixes``
    has conv_id, place, h1, h2."""
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    inner = prefixes.join(ends.select("conv_id", F.col("place").alias("n")), "conv_id").filter("place < n")
    continued = inner.select("place", "h1", "h2").distinct()
    kept = ends.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return kept.join(continued, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def rendered(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TURN
) -> DataFrame:
    """(conv_id, n_turns, chat): the maximal conversations, their turns in order through ``template``."""
    rows = stored(numbered(turns, conv, turn, role, text), "turns")
    keep = maximal(rows.select("conv_id", "place", "h1", "h2"))
    before, _, rest = template.partition("{role}")
    middle, _, after = rest.partition("{text}")
    line = F.concat(F.lit(before), "role", F.lit(middle), "text", F.lit(after))
    chosen = rows.join(keep, "conv_id").select("conv_id", "n_turns", "place", line.alias("line"))
    gathered = chosen.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return gathered.select("conv_id", F.col("n_turns").cast("long"), F.expr("array_join(transform(lines, x -> x.line), '')").alias("chat"))
