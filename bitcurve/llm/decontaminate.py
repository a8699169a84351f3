"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (an item of fewer words is one window). A window
occurs in a text where all its words stand one after the other, so every one of its shingles must be there:
the containment threshold is 1, and the necessary prefix of a window's shingles, ordered by rarity over the
whole corpus, is its rarest one. Documents' shingles are joined with these prefixes alone; a shingle at word p
whose window has it at word o gives the only possible start p - o, which must lie inside the text (position
and length bounds); the words there are then compared exactly.

Neither side is broadcast: a bitmap of fixed size thins out the documents' shingles inside the scan, and what
is left goes through an ordinary join. Windows that occur nowhere (a shingle with no occurrence) are dropped
before the join.

Defined results: a null or empty text has no words and no hits; items without words have no windows; a null
item id counts its hits but is not listed among the items; equal rows each get their row; null ids are ids of
their own; other columns are ignored; with no items nothing is hit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitcurve.llm.bitmap import bitmap_of, marked
from bitcurve.llm.session import ship, stored
from bitcurve.llm.text import LOWER, NOT_ALNUM, Words, row_pieces

WINDOW = 10
GRAM = 3  # words of a shingle; a shorter window is its own shingle


def spelled(words: Words, a: int, b: int) -> str:
    """Words a to b of a batch, lower case, with single spaces."""
    parts = (LOWER[words.data[s:e]].tobytes() for s, e in zip(words.start[a:b], words.end[a:b]))
    return b" ".join(parts).decode("utf-8", "replace")


def windows_of(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item_id, spelling, n_words, shingles) of every window; ``shingles`` in word order."""

    def run(batches):
        for batch in batches:
            for rows in row_pieces(batch, 1):
                words = Words(rows.column(1), NOT_ALNUM)
                grams = {}
                for k in range(1, GRAM + 1):
                    at, value = words.runs(k)
                    grams[k] = np.zeros(len(words.hash) + 1, np.uint64)
                    grams[k][at] = value
                out = []
                for i, item in enumerate(rows.column(0).to_pylist()):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    size = min(window, b - a)
                    k = min(GRAM, size)
                    for s in range(a, b - size + 1) if size else ():
                        shingles = grams[k][s : s + size - k + 1].view(np.int64).tolist()
                        out.append((item, spelled(words, s, s + size), size, shingles))
                columns = list(zip(*out)) or [[], [], [], []]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))
                names = ["item_id", "spelling", "size", "shingles"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = "item_id long, spelling string, size long, shingles array<long>"
    return items.select(F.col(item_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def gram_sizes(windows: DataFrame) -> list[int]:
    """The shingle sizes in use, at most GRAM of them."""
    return sorted(r[0] for r in windows.select(F.least("size", F.lit(GRAM))).distinct().collect())


def occurrences(docs: DataFrame, text: str, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(shingle, n): how often each of the given shingles occurs in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(shingles, "shingle"))

    def run(batches):
        for batch in batches:
            found = []
            for rows in row_pieces(batch, 0):
                words = Words(rows.column(0), NOT_ALNUM)
                for k in sizes:
                    value = words.runs(k)[1]
                    found.append(value[marked(shared.value, value)])
            value, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["shingle", "n"])

    seen = docs.select(F.col(text).cast("string")).mapInArrow(run, "shingle long, n long")
    return seen.groupBy("shingle").agg(F.sum("n").alias("n")).join(shingles, "shingle", "left_semi")


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, offset, spelling, size): every window's rarest shingle. Windows with a shingle that occurs
    nowhere are left out."""
    each = windows.select("spelling", "size", F.posexplode("shingles").alias("offset", "shingle"))
    known = each.join(counts, "shingle", "left")
    rarest = known.groupBy("spelling", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("r")
    )
    return rarest.filter("r.n > 0").select(F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset"), "spelling", "size")


FOUND = "doc_id long, k1 long, k2 long, n_words long, at long, shingle long, context_at long, context string"


def prefix_places(docs: DataFrame, id_column: str, text: str, firsts: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """A row per document with its number of words, and one per place of a prefix shingle with the words
    around it."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(firsts, "shingle"))

    def run(batches):
        for batch in batches:
            for rows in row_pieces(batch, 3):
                words = Words(rows.column(3), NOT_ALNUM)
                first, n = words.first, rows.num_rows
                out = [[], [], [], []]
                owner = [np.arange(n)]
                for k in sizes:
                    at, value = words.runs(k)
                    hit = np.flatnonzero(marked(shared.value, value))
                    for w, h in zip(at[hit].tolist(), value[hit].view(np.int64).tolist()):
                        i = words.row[w]
                        a, b = max(first[i], w - window + 1), min(first[i + 1], w + window)
                        for column, x in zip(out, (w - first[i], h, a - first[i], spelled(words, a, b))):
                            column.append(x)
                    owner.append(words.row[at[hit]])
                own = pa.array(np.concatenate(owner))
                columns = [rows.column(c).take(own) for c in range(3)]
                columns.append(pa.array(np.diff(first).astype(np.int64)).take(own))
                nulls = [None] * n
                columns += [pa.array(nulls + c, pa.int64()) for c in out[:3]] + [pa.array(nulls + out[3], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = keyed.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    return keyed.mapInArrow(run, FOUND)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per document."""
    ship(docs.sparkSession)
    windows = stored(windows_of(items, item_id, item_text, window), "windows")
    distinct = windows.dropDuplicates(["spelling"]).select("spelling", "size", "shingles")
    sizes = gram_sizes(windows)
    shingles = windows.select(F.explode("shingles").alias("shingle")).distinct()
    firsts = stored(prefixes(distinct, occurrences(docs, text, shingles, sizes)), "window-prefixes")
    places = stored(prefix_places(docs, id_column, text, firsts, sizes, window), "prefix-places")
    key = ["doc_id", "k1", "k2"]
    candidates = places.filter("at IS NOT NULL").join(firsts, "shingle").withColumn("start", F.col("at") - F.col("offset"))
    inside = candidates.filter("start >= 0 AND start + size <= n_words")
    here = "array_join(slice(split(context, ' '), int(start - context_at + 1), int(size)), ' ')"
    hits = inside.filter(F.expr(f"{here} = spelling")).select(*key, "start", "size", "spelling").distinct()
    hits = stored(hits, "window-hits")
    # Words in the union of the windows: each adds what lies beyond the furthest end before it.
    before = Window.partitionBy(*key).orderBy("start", "size", "spelling").rowsBetween(Window.unboundedPreceding, -1)
    reach = hits.withColumn("stop", F.col("start") + F.col("size"))
    reach = reach.withColumn("done", F.coalesce(F.max("stop").over(before), F.lit(0)))
    covered = reach.groupBy(*key).agg(F.expr("sum(greatest(0L, stop - greatest(start, done)))").alias("n_hit"))
    listed = hits.select(*key, "spelling").join(windows.select("spelling", "item_id").distinct(), "spelling")
    listed = listed.select(*key, "item_id").distinct().groupBy(*key).agg(
        F.count("item_id").alias("n_items"),
        F.expr("array_join(array_sort(collect_list(string(item_id))), ',')").alias("items"),
    )
    rows = places.filter("at IS NULL").select(*key, "n_words").alias("r")
    found = covered.alias("c").join(listed.alias("l"), same("c", "l")).select("c.*", "l.n_items", "l.items").alias("f")
    joined = rows.join(found, same("r", "f"), "left")
    return joined.select(
        "r.doc_id",
        "r.n_words",
        F.coalesce("f.n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("f.n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("f.items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("f.n_hit", F.lit(0)) > 0).alias("contaminated"),
        "r.k1",
        "r.k2",
    )


def same(a: str, b: str):
    """Rows of one document: ids may be null."""
    return F.expr(f"{a}.k1 <=> {b}.k1 AND {a}.k2 <=> {b}.k2 AND {a}.doc_id <=> {b}.doc_id")


def without_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents no word of which is hit, with all their columns."""
    bad = decontaminate(docs, items, id_column, text).filter("contaminated").select("doc_id", "k1", "k2").distinct()
    left, right = docs.alias("d"), bad.alias("b")
    match = (
        (F.xxhash64(F.col(f"d.{text}")) == F.col("b.k1"))
        & (F.xxhash64(F.lit(1), F.col(f"d.{text}")) == F.col("b.k2"))
        & F.col(f"d.{id_column}").cast("long").eqNullSafe(F.col("b.doc_id"))
    )
    return left.join(right, match, "left_anti")
