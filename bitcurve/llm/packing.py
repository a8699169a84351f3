"""Best-fit packing of documents into sequences of a fixed number of tokens, with conflicts.

No sequence (bin) holds two pieces of one source or of one cluster of duplicates. A document longer than a bin
is cut into full pieces, each a bin by itself, and a rest; a shorter one is its own rest. Rests are packed in
order of falling length: the successor search starts at the least residual that is large enough and goes on to
larger ones until a bin without the rest's source and cluster is found - the tightest compatible bin - and
opens a bin if there is none. Bins of one residual are kept by the bitmap of sources and clusters they carry,
and each source and cluster counts its bins by residual, so a hot source skips the residuals whose bins all
hold it.

Rests are dealt to shards of about SHARD rows by a hash of their place in the table, whatever their source or
cluster, and every shard is packed by itself; only ids and lengths are moved, never texts. The number of
shards follows the number of documents.

Defined results: a null or empty text has no tokens; it takes no room and goes to a bin like any other. Null
sources and clusters conflict with nothing. Equal rows are packed each. An empty table gives no rows. Extra
columns are ignored."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.llm.encode import lengths
from bitcurve.llm.session import ship, stored

CAPACITY = 2048
SHARD = 20_000  # rests packed together


class Bins:
    """Open bins by residual and by the bitmap of the labels (sources and clusters) they carry."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.total = [0] * (capacity + 1)
        self.residuals = 0  # bit r: there is a bin of residual r
        self.holding: dict[int, dict[int, int]] = {}  # label bit -> residual -> bins that carry the label
        self.n = 0

    def _count(self, r: int, labels: list[int], by: int) -> None:
        self.total[r] += by
        self.residuals = self.residuals | 1 << r if self.total[r] else self.residuals & ~(1 << r)
        for label in labels:
            own = self.holding.setdefault(label, {})
            own[r] = own.get(r, 0) + by
            if not own[r]:
                del own[r]

    def place(self, size: int, labels: list[int]) -> int:
        """The bin of a piece: the tightest compatible one, or a new one."""
        mask = 0
        for label in labels:
            mask |= 1 << label
        held = [self.holding.get(label, {}) for label in labels]
        rest = self.residuals >> size
        r = size - 1
        while rest:
            step = (rest & -rest).bit_length()
            r += step
            rest >>= step
            if any(h.get(r, 0) == self.total[r] for h in held):
                continue
            for carried, bins in self.open[r].items():
                if not carried & mask:
                    return self._move(r, carried, bins, size, mask)
        self.n += 1
        self._add(self.capacity - size, mask, self.n - 1)
        return self.n - 1

    def _labels(self, mask: int) -> list[int]:
        out = []
        while mask:
            low = mask & -mask
            out.append(low.bit_length() - 1)
            mask ^= low
        return out

    def _move(self, r: int, carried: int, bins: list[int], size: int, mask: int) -> int:
        chosen = bins.pop()
        if not bins:
            del self.open[r][carried]
        self._count(r, self._labels(carried), -1)
        self._add(r - size, carried | mask, chosen)
        return chosen

    def _add(self, r: int, mask: int, chosen: int) -> None:
        self.open[r].setdefault(mask, []).append(chosen)
        self._count(r, self._labels(mask), 1)


def pack(sizes, sources, clusters, capacity: int) -> np.ndarray:
    """The bin of each piece of one shard."""
    n = len(sizes)
    order = np.lexsort((np.arange(n), -np.asarray(sizes)))
    source_code = pd.factorize(pd.Series(sources))[0]
    cluster_code = pd.factorize(pd.Series(clusters))[0]
    # A cluster that is met once cannot conflict; only the others need a bit.
    often = np.bincount(cluster_code[cluster_code >= 0]) > 1 if (cluster_code >= 0).any() else np.zeros(0, bool)
    bit = np.cumsum(often) - 1 + (source_code.max() + 1 if n else 0)
    bins, out = Bins(capacity), np.zeros(n, np.int64)
    for i in order.tolist():
        labels = [int(source_code[i])] if source_code[i] >= 0 else []
        if cluster_code[i] >= 0 and often[cluster_code[i]]:
            labels.append(int(bit[cluster_code[i]]))
        out[i] = bins.place(int(sizes[i]), labels)
    return out


def measured(docs: DataFrame, tokenizer: str, id_column: str, text: str, source: str, cluster: str | None) -> DataFrame:
    """(doc_id, source, cluster, n_tokens, part, row): the documents with their lengths and places."""

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns[:3], pa.array(lengths(batch.column(3), tokenizer))]
            columns += [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            at += n
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "cluster", "n_tokens", "part", "row"])

    body = F.col(text).cast("string")
    same = F.when(body != "", F.xxhash64(body)) if cluster is None else F.col(cluster).cast("long")
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), same.alias("cluster"), body.alias("text"))
    schema = "doc_id long, source string, cluster long, n_tokens long, part long, row long"
    return stored(plain.mapInArrow(run, schema), "measured")


def best_fit(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    shard: int = SHARD,
) -> DataFrame:
    """(bin_id, doc_id, piece, start, n_tokens, source, cluster) per piece: ``start`` counts the document's
    tokens before the piece. Without a ``cluster`` column, equal texts are one cluster."""
    ship(docs.sparkSession)
    rows = measured(docs, tokenizer, id_column, text, source, cluster)
    shards = max(1, -(-rows.count() // shard))
    cut = rows.withColumn("full", F.expr(f"n_tokens div {capacity} - int(n_tokens > 0 AND n_tokens % {capacity} = 0)"))
    rests = cut.select(
        F.expr(f"pmod(xxhash64(part, row), {shards}L)").alias("shard"),
        "doc_id",
        "source",
        "cluster",
        F.expr("full").alias("piece"),
        F.expr(f"full * {capacity}").alias("start"),
        F.expr(f"n_tokens - full * {capacity}").alias("size"),
        "part",
        "row",
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "row"], ignore_index=True)
        bins = pack(group["size"].to_numpy(), group["source"], group["cluster"], capacity)
        group["bin_id"] = [f"s{group['shard'].iat[0]}-{b}" for b in bins]
        return group[["bin_id", "doc_id", "piece", "start", "size", "source", "cluster"]]

    schema = "bin_id string, doc_id long, piece long, start long, size long, source string, cluster long"
    packed = rests.groupBy("shard").applyInPandas(run, schema)
    fulls = cut.filter("full > 0").withColumn("piece", F.explode(F.expr("sequence(0L, full - 1)")))
    alone = fulls.selectExpr(
        "concat('f', part, '-', row, '-', piece) AS bin_id",
        "doc_id",
        "piece",
        f"piece * {capacity} AS start",
        f"bigint({capacity}) AS size",
        "source",
        "cluster",
    )
    return packed.unionByName(alone).withColumnRenamed("size", "n_tokens")
