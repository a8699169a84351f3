"""Substring dedup by sliding sentence spans.

A sentence ends at a word that ends in . ! or ? and at a line's end. Runs of consecutive sentences are hashed by
their words, lower case, whatever the spacing: from every sentence on, and up to every sentence, the shortest
run of RUN sentences and RUN_WORDS words at least, so that a passage is covered from its first to its last whole
sentence; besides, every single sentence of LONE_WORDS, as passages of long sentences may have no two. Equal spans are
joined over the whole corpus; the first occurrence, by (document id, text, position), stays, and the sentences
that any other occurrence covers are removed. Occurrences inside one document count like all others.

Spans are counted by an aggregate that combines map-side, so a passage held by a third of all documents is
one row per task; a bitmap of fixed size then thins out the spans to those that repeat before they are joined
with their first occurrences. Texts without removals are never shuffled.

Spans and texts are told apart by 64-bit hashes (a text together with its document's id).

Defined results: a null or empty text stays as it is; rows of equal id and text are one document in several
copies, which keep or lose the same sentences; what stays of a text keeps its spelling and spacing, but for
white space at the end; a text may become empty; an empty table gives an empty result; all columns are kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.llm.bitmap import bitmap_of, marked
from bitcurve.llm.session import ship, stored
from bitcurve.llm.text import SPACE, Words, mix, powers, row_pieces

RUN, RUN_WORDS = 2, 10  # a run has RUN_WORDS sentences at most, as each has a word
LONE_WORDS = 40
BITMAP_BITS = 26
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


class Sentences:
    """The sentences of some rows: words first[s]:first[s + 1] make sentence s, which belongs to row[s];
    rows[i]:rows[i + 1] are the sentences of row i."""

    def __init__(self, column):
        self.words = w = Words(column, SPACE)
        n = len(w.start)
        stop = np.ones(n, bool)
        if n:
            breaks = np.flatnonzero(w.data == 10)
            line = np.searchsorted(breaks, w.start[1:]) > np.searchsorted(breaks, w.end[:-1])
            stop[:-1] = _STOP[w.data[w.end[:-1] - 1]] | line | (w.row[1:] != w.row[:-1])
        last = np.flatnonzero(stop)
        self.first = np.append(0, last + 1)
        self.row = w.row[last] if n else np.zeros(0, np.int64)
        self.rows = np.searchsorted(self.row, np.arange(len(w.offsets)))

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first sentence, sentences) of every span."""
        w, n = self.words, len(self.row)
        up, down = powers(len(w.hash) + 1)
        total = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(w.hash * up[: len(w.hash)], out=total[1:])
        first, each = self.first, np.arange(n)
        on = np.maximum(each + RUN, np.searchsorted(first, first[:-1] + RUN_WORDS))
        up_to = np.minimum(each + 1 - RUN, np.searchsorted(first, first[1:] - RUN_WORDS, "right") - 1)
        starts = np.concatenate([each, up_to, each])
        stops = np.concatenate([on, each + 1, each + 1])
        least = np.repeat([RUN_WORDS, RUN_WORDS, LONE_WORDS], n)
        fits = (starts >= 0) & (stops <= n)
        starts, stops, least = starts[fits], stops[fits], least[fits]
        take = (self.row[starts] == self.row[stops - 1]) & (first[stops] - first[starts] >= least)
        key = np.unique(starts[take] * 16 + stops[take] - starts[take])
        at, k = key // 16, key % 16
        a, b = first[at], first[at + k]
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at, k

def spans_of(keyed: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(h, doc_id, k1, place): all spans, or those marked in a bitmap; ``place`` is 16 * sentence + sentences."""
    shared = None if only is None else keyed.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        for batch in batches:
            for rows in row_pieces(batch, 2):
                sentences = Sentences(rows.column(2))
                value, at, k = sentences.spans()
                if shared is not None:
                    keep = marked(shared.value, value)
                    value, at, k = value[keep], at[keep], k[keep]
                own = sentences.row[at]
                place = (at - sentences.rows[own]) * 16 + k
                take = pa.array(own)
                columns = [pa.array(value.view(np.int64)), rows.column(0).take(take), rows.column(1).take(take)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(place)], ["h", "doc_id", "k1", "place"])

    return keyed.mapInArrow(run, "h long, doc_id long, k1 long, place long")


def kept_text(raw: str, places: list[int]) -> tuple[str, int]:
    """A text without the sentences that the spans at ``places`` cover, and their number."""
    s = Sentences(pa.array([raw]))
    gone = np.zeros(len(s.row), bool)
    for place in places:
        gone[place // 16 : place // 16 + place % 16] = True
    edge = s.words.start[s.first[:-1]]
    cuts = np.append(edge, len(s.words.data))
    data = s.words.data.tobytes()
    parts = [data[: cuts[0]], *(data[a:b] for a, b, out in zip(cuts[:-1], cuts[1:], gone) if not out)]
    return b"".join(parts).decode("utf-8", "replace").rstrip(), int(gone.sum())


def remove_repeated_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", removed: str = "n_removed") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and the number of sentences removed in a column
    of the given name, which takes the place of one of theirs that has it."""
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("k1"), F.col(f"`{text}`").cast("string").alias("text")
    )
    where = F.struct("doc_id", "k1", "place")
    repeated = spans_of(keyed).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("first"))
    repeated = stored(repeated.filter("n > 1").select("h", "first"), "repeated-spans")
    again = spans_of(keyed, bitmap_of(repeated, "h", BITMAP_BITS)).join(repeated, "h")
    later = again.filter("NOT (doc_id <=> first.doc_id AND k1 = first.k1 AND place = first.place)")
    cuts = stored(later.groupBy("doc_id", "k1").agg(F.collect_set("place").alias("places")), "span-cuts")
    shared = spark.sparkContext.broadcast(bitmap_of(cuts, "k1"))

    @F.pandas_udf("boolean")
    def touched(k1: pd.Series) -> pd.Series:
        return pd.Series(marked(shared.value, k1.to_numpy(np.int64).view(np.uint64)))

    @F.pandas_udf("struct<text: string, n: long>")
    def cut(raw: pd.Series, places: pd.Series) -> pd.DataFrame:
        done = [(t, 0) if p is None else kept_text(t, list(p)) for t, p in zip(raw, places)]
        return pd.DataFrame(done, columns=["text", "n"])

    kept = [c for c in docs.columns if c != removed]
    flagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")).withColumn("k", F.xxhash64(F.col(f"row.`{text}`").cast("string")))
    flagged = flagged.withColumn("touched", touched("k"))
    whole = flagged.filter("NOT touched").select("row.*", F.lit(0).cast("long").alias(removed))
    other = flagged.filter("touched").join(
        cuts, (F.col("k") == F.col("k1")) & F.col(f"row.`{id_column}`").cast("long").eqNullSafe(F.col("doc_id")), "left"
    )
    other = other.withColumn("done", cut(F.col(f"row.`{text}`").cast("string"), F.col("places")))
    columns = [F.col("done.text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept]
    return whole.unionByName(other.select(*columns, F.col("done.n").alias(removed)))
