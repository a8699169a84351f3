"""Token counts: the exact histogram of encoded lengths and what its suffix sums answer.

Documents are encoded and counted by length inside the tasks; only (length, count) pairs are exchanged.
With n(L) documents of length L and more, T(L) tokens in them and N(L), S(L) documents and tokens below:

    truncated total at limit L = S(L) + L * n(L)          tokens cut away = T(L) - L * n(L)

so one pass over the corpus answers every context limit. Suffix sums are taken in two steps, over blocks of
lengths and inside each block, so no step orders all lengths in one task.

Defined results: a null or empty text has length 0 and counts as a document; an empty table gives no rows;
repeated rows count each; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitcurve.llm.encode import lengths
from bitcurve.llm.session import ship, stored

BLOCK = 1024  # lengths per block of the two-step sums


def histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): documents by exact encoded length."""
    ship(docs.sparkSession)

    def count(batches):
        for batch in batches:
            length, number = np.unique(lengths(batch.column(0), tokenizer), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(number)], ["n_tokens", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "n_tokens long, n long")
    # Written, as the sums below read it several times and the corpus is to be encoded once.
    return stored(counted.groupBy("n_tokens").agg(F.sum("n").alias("n_docs")), "length-histogram")


def with_suffix_sums(lengths_table: DataFrame) -> DataFrame:
    """The histogram with, per length L: docs_from and tokens_from (length L and more), docs_below, tokens_below,
    truncated_total (tokens kept if every document is cut at L), lost_total, and quantile (share of documents
    of at most this length)."""
    sized = lengths_table.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("t"), F.expr(f"n_tokens div {BLOCK} AS block")
    )
    blocks = sized.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("t").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = blocks.select(
        "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("bn", "bt")]
    )
    total = sized.agg(F.sum("n_docs").alias("docs"), F.sum("t").alias("tokens"))
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    summed = sized.join(after, "block").crossJoin(F.broadcast(total))  # one row
    return summed.select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(down) + F.col("bn_after")).alias("docs_from"),
        (F.sum("t").over(down) + F.col("bt_after")).alias("tokens_from"),
        "docs",
        "tokens",
    ).selectExpr(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        "docs - docs_from AS docs_below",
        "tokens - tokens_from AS tokens_below",
        "tokens - tokens_from + n_tokens * docs_from AS truncated_total",
        "tokens_from - n_tokens * docs_from AS lost_total",
        "double(docs - docs_from + n_docs) / docs AS quantile",
    )


def at_limits(sums: DataFrame, limits) -> DataFrame:
    """Truncated and lost totals for any context limits: the first length at or above a limit carries the
    counts, as no document ends in between. A limit above every length cuts nothing."""
    rows = [
        F.struct(
            F.lit(int(limit)).alias("context_limit"),
            F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "docs_from", "tokens_from", "tokens_below"))).alias("at"),
            F.max(F.col("tokens_from") + F.col("tokens_below")).alias("total"),
        )
        for limit in limits
    ]
    found = sums.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r"))
    return found.selectExpr(
        "r.context_limit",
        "coalesce(r.at.tokens_below + r.context_limit * r.at.docs_from, r.total) AS truncated_total",
        "coalesce(r.at.docs_from, 0) AS docs_reaching",
        "coalesce(r.at.tokens_from - r.context_limit * r.at.docs_from, 0) AS lost_total",
    )


def quantiles(sums: DataFrame, probabilities) -> DataFrame:
    """The smallest length that at least a share p of the documents does not exceed."""
    picks = [
        F.struct(F.lit(float(p)).alias("p"), F.min(F.when(F.col("quantile") >= p, F.col("n_tokens"))).alias("n_tokens"))
        for p in probabilities
    ]
    return sums.agg(F.array(*picks).alias("rows")).select(F.explode("rows").alias("r")).select("r.p", "r.n_tokens")
