"""Shards of near-equal size by histogram sort: exact byte counts below candidate boundaries, refined until every
boundary is good enough, then one exchange.

Rows are ordered by a 62-bit key: 32 bits of the text's md5, then 30 of the id's. Equal texts are therefore
neighbours, and a boundary inside the first 32 bits keeps them together. The probes of a round are the boundaries
between key prefixes of the round's length (``SHIFTS``). One aggregate, combined map-side, counts the bytes and rows
between neighbouring probes; a shard's boundary that falls between two probes takes the nearer one if that is within
``tolerance`` (a share of a shard's bytes) of where it should be, and otherwise only this interval is probed again,
with longer prefixes. Boundaries inside a group of equal texts come up only where the group is larger than the
tolerance allows. The rounds read a narrow table of keys and sizes; the texts are read once to write it and once to be
exchanged.

At the exchange every row goes to its *piece*: a run of keys inside one shard with about ``piece_bytes`` bytes, cut at the
same probes (intervals with many times that are probed further as well), so neither a shard nor a group of copies with a
third of all rows is the work of one task. The counts of all pieces are known, so a row's slot is its place in its piece,
ordered by (key, id, text), plus the rows of the pieces before it in the shard.

Only built-in functions are used: no Python worker runs. What reaches the driver are the counts of the first round (at most
65,536) and of the intervals probed again (at most 1,024 for each).

Defined results: a null text has size 8 and the key of an empty one; a null id that of an empty string; rows equal in
text and id have one key and stay together in one shard; an empty table gives no rows; there are empty shards where rows
are fewer or larger than shards; result columns replace columns of the same names, all others are kept."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitcurve.llm.session import discard, stored

SHIFTS = (46, 38, 30, 20, 10, 0)  # key bits below the prefix, round by round; 30 ends the text's part
PIECE_BYTES = 128 << 20
MAX_PIECES = 1 << 14
ADDED = 8  # bytes that a row counts besides its text


def key_column(text: str, id_column: str):
    def bits(value, digits):
        return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")

    group = bits(F.coalesce(F.col(f"`{text}`"), F.lit("")), 8)
    within = F.shiftright(bits(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")), 8), 2)
    return F.shiftleft(group, 30) + within


def size_column(text: str):
    return (F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) + F.lit(ADDED)).cast("long")


class Intervals:
    """Key intervals in order: ``low`` key, ``shift`` (2**shift keys wide), bytes and rows."""

    def __init__(self, table: np.ndarray):
        self.low, self.shift, self.bytes, self.rows = table[:, table[0].argsort(kind="stable")]
        self.before = np.cumsum(self.bytes) - self.bytes

    def refined(self, parents: np.ndarray, table: np.ndarray) -> Intervals:
        rest = np.stack([self.low, self.shift, self.bytes, self.rows])[:, ~parents]
        return Intervals(np.hstack([rest, table]))


def probe(keyed: DataFrame, shift: int, inside: tuple[int, np.ndarray] | None) -> np.ndarray:
    """Exact bytes and rows of every prefix interval; only inside the prefixes asked for, if any."""
    if inside is not None:
        coarse, low = inside
        keyed = keyed.filter(F.shiftright("key", coarse).isin([int(v) >> coarse for v in low]))
    counts = keyed.groupBy(F.shiftright("key", shift).alias("prefix")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    found = counts.toArrow()
    low = found["prefix"].to_numpy() << shift
    return np.stack([low, np.full(len(low), shift), found["bytes"].to_numpy(), found["rows"].to_numpy()]).astype(np.int64)


def splitters(keyed: DataFrame, shards: int, tolerance: float, piece_bytes: int) -> tuple[list[int], Intervals]:
    """The first key of every shard but the first, and the intervals of the last round, none of which holds a
    splitter inside."""
    spans = Intervals(probe(keyed, SHIFTS[0], None))
    total = int(spans.bytes.sum())
    allowed = int(round(1 / tolerance))
    piece = max(piece_bytes, total // MAX_PIECES)
    cuts: dict[int, int] = {}
    for at, shift in enumerate(SHIFTS):
        again = (spans.bytes > 8 * piece) & (spans.rows > 1) & (spans.shift == shift)
        for k in range(1, shards):
            if k in cuts or not total:
                continue
            i = int(np.searchsorted(spans.before * shards, k * total, "right")) - 1
            below = k * total - shards * int(spans.before[i])
            above = shards * int(spans.before[i] + spans.bytes[i]) - k * total
            if min(below, above) * allowed <= total or shift == 0:
                cuts[k] = int(spans.low[i]) + (0 if below <= above else 1 << shift)
            else:
                again[i] = True
        if shift == 0 or not again.any():
            break
        spans = spans.refined(again, probe(keyed, SHIFTS[at + 1], (shift, spans.low[again])))
    return [cuts[k] for k in range(1, shards) if k in cuts], spans


def pieces(cuts: list[int], spans: Intervals, piece_bytes: int) -> tuple[list[int], list[int], list[int]]:
    """First key, shard, and first slot of every piece."""
    piece = max(piece_bytes, int(spans.bytes.sum()) // MAX_PIECES)
    shard = np.searchsorted(np.asarray(cuts, np.int64), spans.low, "right")
    first, owner, slot = [], [], []
    held = rows = 0
    for low, own, size, count in zip(spans.low.tolist(), shard.tolist(), spans.bytes.tolist(), spans.rows.tolist()):
        if not owner or owner[-1] != own:
            rows = 0
        if not owner or owner[-1] != own or held + size > piece:
            first.append(low)
            owner.append(own)
            slot.append(rows)
            held = 0
        held += size
        rows += count
    return first, owner, slot


def longs(values: list[int]):
    return F.array(*[F.lit(v).cast("long") for v in values])


def place(bounds: list[int], key: str):
    """How many of the sorted bounds are at most ``key``, by bisection."""
    if not bounds:
        return F.lit(0)
    table = f"array({','.join(f'{b}L' for b in bounds)})"
    steps = ",".join(str(1 << s) for s in reversed(range(len(bounds).bit_length())))
    step = f"CASE WHEN a + s > {len(bounds)} THEN a WHEN element_at({table}, a + s) <= {key} THEN a + s ELSE a END"
    return F.expr(f"aggregate(array({steps}), 0, (a, s) -> {step})")


def histogram_sort(
    docs: DataFrame,
    shards: int = 24,
    id_column: str = "doc_id",
    text: str = "text",
    tolerance: float = 0.005,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``size``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in
    every shard), in slot order inside each partition; a partition holds rows of one shard."""
    own = ("size", "shard", "slot")
    # The row travels as one struct, so none of its columns can clash with the operator's.
    packed = docs.select(
        key_column(text, id_column).alias("key"),
        size_column(text).alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own]).alias("row"),
    )
    keyed = stored(packed.select("key", "size"), "shard-keys")
    cuts, spans = splitters(keyed, shards, tolerance, piece_bytes)
    discard(keyed)
    first, owner, slot = pieces(cuts, spans, piece_bytes)
    numbered = packed.withColumn("piece", place(first[1:], "key"))
    order = Window.partitionBy("piece").orderBy("key", F.col(f"row.`{id_column}`"), F.col(f"row.`{text}`"))
    dealt = numbered.repartitionById(max(1, len(first)), F.col("piece")).withColumn("rank", F.row_number().over(order))
    which = F.col("piece") + 1
    return dealt.select(
        "row.*",
        "size",
        F.element_at(longs(owner or [0]), which).cast("int").alias("shard"),
        (F.element_at(longs(slot or [0]), which) + F.col("rank") - 1).alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a task writes the rows of one piece in slot order."""
    sharded.write.partitionBy("shard").parquet(path)


def shard_digests(docs: DataFrame, shards: int = 24) -> DataFrame:
    """What is checked of the sharded rows: size, checksum of the text, shard and slot."""
    return histogram_sort(docs, shards).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
