"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5 bytes, with marks for its ends), hashed into a table of
embeddings. The embeddings of a window of consecutive words are averaged and go through a linear softmax of two
classes; table and softmax are trained together, in numpy. Misspellings that were never seen share most n-grams
with words that were. A text scores as its worst window, so a few words are found in a text of any length:
training does the same, a text's label going to the window that scores highest.

The model is fitted on at most MAX_LABELLED labelled texts (a documented bound; chosen by a hash of their ids,
half from either class where there are enough), none of them held out. Scoring covers every word of every text.
As the model is linear in the averaged n-grams, a trained model is one number per n-gram, which goes to the
executors: a table of fixed size.

Held-out documents are those whose crc32 of the id, as text, leaves 0 modulo 5. A score uses the text alone.

Defined results: a null or empty text, or one without words, scores 0; a null id is never held out (its crc32
is null) and never trained on; equal rows score equally; labels that are null or of unknown documents are
ignored; repeated labels count once each; without labels of both classes every score is 0; other columns are
ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.llm.encode import forget, give_back
from bitcurve.llm.session import ship
from bitcurve.llm.text import LOWER, NOT_ALNUM, Words, mix, row_pieces

MAX_LABELLED = 8_000
BUCKETS = 1 << 17
DIM = 8
WINDOW = 3  # words averaged; few, so that a word is not drowned by its neighbours
GRAMS = (3, 4, 5)
ROUNDS = 8
PASSES = 3  # over the windows of a round
BATCH = 128
PIECE = 50_000  # words whose n-grams are in memory at once
RATE = 0.02

_CODE = np.random.default_rng(11).integers(1, 2**62, 258, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, count): the n-gram buckets of each word, one word after the other, and their number per word."""
    length = end - start + 2
    first = np.cumsum(length) - length
    total = int(length.sum())
    word = np.repeat(np.arange(len(start)), length)
    place = np.arange(total) - first[word]
    code = np.full(total, 256, np.int64)
    inner = (place > 0) & (place < length[word] - 1)
    code[inner] = LOWER[data[(start[word] + place - 1)[inner]]]
    code[place == length[word] - 1] = 257
    value = _CODE[code]
    found, owner = [], []
    h = np.zeros(total, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        size = total - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x100000001B3) + value[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(place[:size] + n <= length[word[:size]])
            found.append((mix(h[at] + np.uint64(n)) >> np.uint64(47)).astype(np.int64))
            owner.append(word[:size][at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(start), np.int64)
    buckets, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.bincount(owner, minlength=len(start))


class Vocabulary:
    """The distinct words of some texts and their n-grams. ``code`` numbers the words in text order, those of
    text i from row[i] on; the n-grams of word k are buckets[first[k]:first[k + 1]]. Texts are taken a few at a
    time, so besides these arrays little memory is needed."""

    def __init__(self, column):
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        known, hashes, rows, buckets, counts = np.zeros(0, np.uint64), [], [np.zeros(1, np.int64)], [], []
        for piece in row_pieces(batch, 0):
            w = Words(piece.column(0), NOT_ALNUM)
            new, at = np.unique(w.hash, return_index=True)
            fresh = ~np.isin(new, known)
            new, at = new[fresh], at[fresh]
            for some in np.array_split(at, len(at) // 20_000 + 1):
                own, count = grams_of(w.data, w.start[some], w.end[some])
                buckets.append(own.astype(np.int32))
                counts.append(count.astype(np.int32))
            known = np.concatenate([known, new])
            hashes.append(w.hash)
            rows.append(np.diff(w.first))
        self.row = np.cumsum(np.concatenate(rows))
        order = np.argsort(known, kind="stable")
        known = known[order]
        self.code = np.concatenate([order[np.searchsorted(known, h)].astype(np.int32) for h in hashes] or [np.zeros(0, np.int32)])
        self.buckets = np.concatenate(buckets or [np.zeros(0, np.int32)])
        self.count = np.concatenate(counts or [np.zeros(0, np.int32)]).astype(np.int64)
        self.first = np.append(0, np.cumsum(self.count))

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Per distinct word the sum of its n-grams' weights."""
        some = np.flatnonzero(self.count)
        out = np.zeros(len(self.count))
        for part in np.array_split(some, len(some) // 50_000 + 1):
            if len(part):
                a, b = self.first[part[0]], self.first[part[-1] + 1]
                out[part] = np.add.reduceat(weight[self.buckets[a:b]], self.first[part] - a)
        return out


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first[i], first[i] + 1, ... of ``count[i]`` places each, one run after the other."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def worst_windows(vocabulary: Vocabulary, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words, mean weight) of the highest window of every text that has words."""
    sums, row = vocabulary.sums(weight), vocabulary.row
    out = []
    for texts in np.array_split(np.arange(len(row) - 1), len(vocabulary.code) // 500_000 + 1):
        if len(texts) and row[texts[-1] + 1] > row[texts[0]]:
            a, b = row[texts[0]], row[texts[-1] + 1]
            own = row[texts[0] : texts[-1] + 2] - a
            text, first, words, mean = _worst(own, sums[vocabulary.code[a:b]], vocabulary.count[vocabulary.code[a:b]])
            out.append((text + texts[0], first + a, words, mean))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    return tuple(np.concatenate(c) for c in zip(*out))


def _worst(row, value, count):
    total, many = np.append(0.0, np.cumsum(value)), np.append(0, np.cumsum(count))
    size = np.diff(row)
    owner = np.repeat(np.arange(len(size)), size)
    first = np.arange(max(0, len(value) - WINDOW + 1))
    first = first[owner[first] == owner[first + WINDOW - 1]]
    short = np.flatnonzero((size > 0) & (size < WINDOW))  # one window each
    first, words = np.append(first, row[short]), np.append(np.full(len(first), WINDOW), size[short])
    means = (total[first + words] - total[first]) / np.maximum(many[first + words] - many[first], 1)
    order = np.lexsort((means, owner[first]))
    texts = owner[first][order]
    best = order[np.append(texts[1:] != texts[:-1], True)]
    return owner[first[best]], first[best], words[best], means[best]


def pieces(vocabulary: Vocabulary, first: np.ndarray, words: np.ndarray):
    """(window, n-grams, buckets of these) of the words of some windows, for some PIECE words at a time; a window
    may come in several parts."""
    parts = -(-words // PIECE)
    owner = np.repeat(np.arange(len(words)), parts)
    place = spread(np.zeros(len(words), np.int64), parts) * PIECE
    size = np.minimum(words[owner] - place, PIECE)
    for some in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // PIECE)) + 1):
        own = vocabulary.code[spread(first[owner[some]] + place[some], size[some])]
        count = vocabulary.count[own]
        start = np.cumsum(size[some]) - size[some]
        yield owner[some], np.add.reduceat(count, start), vocabulary.buckets[spread(vocabulary.first[own], count)]


class Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape), np.zeros(shape), 0

    def step(self, value: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        m, v = 0.9 * self.m[rows] + 0.1 * gradient, 0.999 * self.v[rows] + 0.001 * gradient**2
        self.m[rows], self.v[rows] = m, v
        value[rows] -= RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) * m / (np.sqrt(v) + 1e-8)


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Train embeddings and softmax together; returned as the logit weight of every bucket and the bias.

    The first round averages whole texts; each later one takes every text's highest window under the model so
    far. Windows of clean texts stay in the training set once they were the highest."""
    random = np.random.default_rng(seed)
    vocabulary = Vocabulary(texts)
    row = vocabulary.row
    table, top, bias = random.normal(0, 0.1, (BUCKETS, DIM)), random.normal(0, 0.1, DIM), np.zeros(1)
    adam = Adam(table.shape), Adam(DIM), Adam(1)
    text = np.flatnonzero(np.diff(row) > 0)
    first, words = row[text], np.diff(row)[text]
    clean = np.zeros((3, 0), np.int64)
    for round_ in range(ROUNDS):
        if round_:
            text, first, words, _ = worst_windows(vocabulary, table @ top)
            low = labels[text] == 0
            clean = np.unique(np.hstack([clean, np.stack([text, first, words])[:, low]]), axis=1)
            text, first, words = np.hstack([np.stack([text, first, words])[:, ~low], clean])
        # Either class weighs the same, however many windows it has.
        y = labels[text]
        share = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
        for _ in range(PASSES):
            order = random.permutation(len(text))
            for part in np.array_split(order, max(1, len(order) // BATCH)):
                total, grams = np.zeros(len(part)), np.zeros(len(part), np.int64)
                for owner, many, bucket in pieces(vocabulary, first[part], words[part]):
                    np.add.at(grams, owner, many)
                    np.add.at(total, owner, np.add.reduceat(table[bucket] @ top, np.cumsum(many) - many))
                error = (sigmoid(total / grams + bias) - y[part]) * share[part] / len(part)
                push = np.zeros(BUCKETS)
                for owner, many, bucket in pieces(vocabulary, first[part], words[part]):
                    push += np.bincount(bucket, np.repeat((error / grams)[owner], many), BUCKETS)
                hit = np.flatnonzero(push)
                along = push[hit] @ table[hit]
                adam[0].step(table, push[hit, None] * top, hit)
                adam[1].step(top, along)
                adam[2].step(bias, error.sum(keepdims=True))
    return (table @ top).astype(np.float32), float(bias[0])


def scores(column, weight: np.ndarray, bias: float) -> np.ndarray:
    """The worst window's probability for each text of a column."""
    forget()
    vocabulary = Vocabulary(column)
    out = np.zeros(len(vocabulary.row) - 1)
    text, _, _, mean = worst_windows(vocabulary, weight)
    out[text] = sigmoid(mean + bias)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str) -> DataFrame:
    """(id, y, text) of at most MAX_LABELLED labelled documents that are not held out; of an id that stands before several
    texts the least one counts."""
    known = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.filter("id IS NOT NULL AND y IS NOT NULL AND crc32(string(id)) % 5 <> 0").withColumn("h", F.xxhash64("id"))
    half = MAX_LABELLED // 2
    known = known.distinct()
    picked = known.filter("y = 1").orderBy("h", "id").limit(half).unionByName(
        known.filter("y = 0").orderBy("h", "id").limit(half)
    )
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # At most MAX_LABELLED ids.
    rows = texts.filter("text IS NOT NULL").join(F.broadcast(picked.select("id", "y")), "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text"))


def fit_rows(table: pa.Table) -> pa.Table:
    """The model of training rows (id, y, text), as one row, or none without labels of both classes."""
    kind = pa.schema([("weights", pa.binary()), ("bias", pa.float64())])
    table = table.sort_by([("id", "ascending"), ("y", "ascending")])
    y = table["y"].to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return kind.empty_table()
    forget()
    weights, bias = fit(table["text"].cast(pa.large_string()).combine_chunks(), y)
    give_back()
    return pa.table([pa.array([weights.tobytes()]), pa.array([bias])], schema=kind)


def model(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic"):
    """The fitted model, or None without labels of both classes.

    It is fitted in one task, on rows whose number is bounded: their texts never reach the driver. The task holds
    the texts, some 12 bytes for each of their words and 100 for each distinct word."""
    rows = training_rows(docs, labels, id_column, text, label)
    found = rows.withColumn("fit", F.lit(0)).groupBy("fit").applyInArrow(fit_rows, "weights binary, bias double").toArrow()
    if not found.num_rows:
        return None
    return np.frombuffer(found["weights"][0].as_py(), np.float32), found["bias"][0].as_py()


def score_documents(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model(docs, labels, id_column, text, label))

    def run(batches):
        for batch in batches:
            for rows in row_pieces(batch, 1):
                found = np.zeros(rows.num_rows) if shared.value is None else scores(rows.column(1), *shared.value)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found)], ["doc_id", "score"])

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string"))
    scored = plain.mapInArrow(run, "doc_id long, score double")
    held = F.expr("coalesce(crc32(string(doc_id)) % 5 = 0, false)")
    return scored.select("doc_id", held.alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"))


def without_toxic(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model(docs, labels, id_column, text, label))

    @F.arrow_udf("double")  # the texts stay Arrow data: no Python string is made
    def score(column: pa.Array) -> pa.Array:
        if shared.value is None:
            return pa.array(np.zeros(len(column)))
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        parts = [scores(rows.column(0), *shared.value) for rows in row_pieces(batch, 0)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(score(F.col(text).cast("string")) < 0.5)
