"""Quality scores by co-training a text-content and a page-metadata classifier.

The content view sees which words a text has (hashed, with their marks) and how often they repeat; the metadata
view sees source, language, size and the page's layout: lines, capitals, digits, marks. Both are logistic
regressions trained in numpy. Over some rounds each labels the unlabelled documents it is surest of, as many of
either class as the labels' shares suggest, for the other to learn from. In the end both are calibrated and
combined on labelled documents that neither was trained on, and every document is scored.

Every round scores all unlabelled documents on the executors, and the surest are those beyond a quantile of all
their scores, from counts per thousandth of a logit (where a count is split, by a hash). What a document was taught
in earlier rounds follows from the weights and quantiles of those rounds, so nothing of the corpus is kept. Bounded
are the rows that go into a fit: at most MAX_LABELLED labelled documents, and MAX_TAUGHT that the other view labelled,
chosen by hashes; only their features reach the driver. Documents whose crc32 of the id, as text, leaves 0 modulo 5
are held out of both. Scoring covers every word of every text.

Defined results: a null or empty text has no words, and its score rests on the metadata; null source and
language are values of their own; a null id is never trained on; labels that are null or of unknown documents
are ignored; without labels of both classes every score is 0.5; equal rows score equally; other columns are
ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitcurve.llm.session import discard, release, ship, stored
from bitcurve.llm.text import SPACE, Words, row_pieces

MAX_LABELLED = 6_000
MAX_TAUGHT = 6_000  # in all rounds together, for each view
BUCKETS = 1 << 15
ROUNDS = 4
ADDED = 0.1  # share of the unlabelled documents that a view labels for the other per round
UNIT, TOP = 24, 64  # logits in the exchange are whole multiples of 2**-UNIT, of TOP at most
STEP = UNIT - 10  # and are counted per 2**STEP of these
PASSES = 12
BATCH = 256
RATE = 0.05

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


class Sparse:
    """Rows of (feature, value) pairs."""

    def __init__(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray):
        self.first, self.feature, self.value = first, feature, value

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        count = np.diff(self.first)[rows]
        index = np.arange(count.sum()) + np.repeat(self.first[:-1][rows] - (np.cumsum(count) - count), count)
        return Sparse(np.append(0, np.cumsum(count)), self.feature[index], self.value[index])

    def dot(self, weight: np.ndarray) -> np.ndarray:
        total = np.append(0.0, np.cumsum(weight[self.feature] * self.value))
        return total[self.first[1:]] - total[self.first[:-1]]

    @staticmethod
    def stack(parts: list[Sparse]) -> Sparse:
        count = np.concatenate([np.diff(p.first) for p in parts]) if parts else np.zeros(0, np.int64)
        feature = np.concatenate([p.feature for p in parts]) if parts else np.zeros(0, np.int64)
        value = np.concatenate([p.value for p in parts]) if parts else np.zeros(0)
        return Sparse(np.append(0, np.cumsum(count)), feature, value)


def content_view(words: Words) -> Sparse:
    """Word frequencies, the share of distinct words in tenths, and a constant."""
    n = len(words.offsets) - 1
    size = np.diff(words.first)
    bucket = (words.hash >> np.uint64(49)).astype(np.int64)
    key, count = np.unique(words.row * BUCKETS + bucket, return_counts=True)
    row, feature = key // BUCKETS, key % BUCKETS
    value = np.sqrt(count / size[row])
    distinct = np.bincount(row, minlength=n)
    tenth = np.minimum(9, (10 * distinct / np.maximum(size, 1)).astype(np.int64))
    rows = np.concatenate([row, np.arange(n), np.arange(n)])
    features = np.concatenate([feature, BUCKETS + tenth, np.full(n, BUCKETS + 10)])
    values = np.concatenate([value, (size > 0).astype(float), np.ones(n)])
    return by_row(n, rows, features, values)


def by_row(n, rows, features, values) -> Sparse:
    order = np.argsort(rows, kind="stable")
    first = np.append(0, np.cumsum(np.bincount(rows, minlength=n)))
    return Sparse(first, features[order], values[order])


def in_bins(value: np.ndarray, edges) -> np.ndarray:
    return np.searchsorted(np.asarray(edges), value, "right")


def metadata_view(words: Words, source: list, lang: list) -> Sparse:
    """Source, language, size and layout, each as one of some bins (1,024 features at most)."""
    n = len(words.offsets) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return total[words.offsets[1:]] - total[words.offsets[:-1]]

    d = words.data
    size = np.diff(words.offsets)
    letters = np.maximum(per_row(_UPPER[d]) + per_row(_LOWER[d]), 1)
    lines = per_row(d == 10) + 1
    count = np.maximum(np.diff(words.first), 1)
    shares = (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5)
    binned = [
        in_bins(np.log2(size + 1), range(1, 24)),
        in_bins(np.log2(lines), range(1, 20)),
        in_bins(np.log2(size / lines + 1), range(1, 24)),
        in_bins(per_row(_UPPER[d]) / letters, shares),
        in_bins(per_row(_DIGIT[d]) / np.maximum(size, 1), shares),
        in_bins(per_row(_MARK[d]) / np.maximum(size, 1), shares),
        in_bins(per_row(_MARK[d]) / count, (0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8, 1, 1.5, 2, 3)),
    ]
    features = [64 * k + b for k, b in enumerate(binned)]
    features.append(512 + np.array([zlib.crc32(str(s).encode()) % 256 for s in source], np.int64))
    features.append(768 + np.array([zlib.crc32(str(x).encode()) % 64 for x in lang], np.int64))
    features.append(np.full(n, 1023))
    k = len(features)
    return Sparse(np.arange(0, n * k + 1, k), np.stack(features, 1).ravel() if n else np.zeros(0, np.int64), np.ones(n * k))


def views(batch, text: int, source: int, lang: int) -> tuple[Sparse, Sparse]:
    words = Words(batch.column(text), SPACE)
    return content_view(words), metadata_view(words, batch.column(source).to_pylist(), batch.column(lang).to_pylist())


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(x: Sparse, y: np.ndarray, n_features: int, seed: int) -> np.ndarray:
    """Logistic regression by AdaGrad with a little weight decay."""
    random = np.random.default_rng(seed)
    weight, seen = np.zeros(n_features), np.full(n_features, 1e-6)
    for _ in range(PASSES):
        order = random.permutation(len(y))
        for part in np.array_split(order, max(1, len(order) // BATCH)):
            own = x.take(part)
            error = (sigmoid(own.dot(weight)) - y[part]) / len(part)
            slope = np.bincount(own.feature, np.repeat(error, np.diff(own.first)) * own.value, n_features)
            slope += 1e-5 * weight
            seen += slope * slope
            weight -= RATE * slope / np.sqrt(seen)
    return weight


def calibrated(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on a few dense columns, by Newton's method with a ridge."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w)
        w -= step
    return w


def levels(x: Sparse, weight: np.ndarray) -> np.ndarray:
    """Logits in units of 2**-UNIT. They are sums of integers, so a row has the same one in every batch."""
    total = np.append(0, np.cumsum(np.rint(weight[x.feature] * x.value * (1 << UNIT)).astype(np.int64)))
    return np.clip(total[x.first[1:]] - total[x.first[:-1]], -(TOP << UNIT), TOP << UNIT)


def cut_of(steps: np.ndarray, count: np.ndarray, low: int, high: int) -> tuple[int, float, int, float]:
    """The ``low`` least of the negative and ``high`` greatest of the other levels, given the number of rows per step
    (ascending): all below the first step and above the second, and the given shares of these."""

    def edge(at, many, n, beyond, none):
        total = np.cumsum(many)
        if n <= 0:
            return none, 0.0
        if not len(at) or total[-1] < n:
            return beyond, 0.0
        k = int(np.searchsorted(total, n))
        return int(at[k]), float((n - (total[k] - many[k])) / many[k])

    far = TOP << 12
    bad, good = steps < 0, steps >= 0
    return edge(steps[bad], count[bad], low, 0, -far) + edge(steps[good][::-1], count[good][::-1], high, -1, far)


def sides(z: np.ndarray, pick: np.ndarray, cut: tuple) -> np.ndarray:
    """0 or 1 for the rows that a view is surest of and itself puts on that side, else -1."""
    low, low_share, high, high_share = cut
    step = z >> STEP
    bad = (z < 0) & ((step < low) | ((step == low) & (pick < low_share)))
    good = (z > 0) & ((step > high) | ((step == high) & (pick < high_share)))
    return np.where(bad, 0, np.where(good, 1, -1))


def taught(history: list, both: tuple[Sparse, Sparse], pick: np.ndarray) -> list[np.ndarray]:
    """What either view was taught about each row in the rounds so far: 0, 1, or -1 for nothing."""
    known = [np.full(len(pick), -1), np.full(len(pick), -1)]
    for weights, cuts in history:
        for view in (0, 1):
            side = sides(levels(both[view], weights[view]), pick, cuts[view])
            known[1 - view] = np.where(known[1 - view] < 0, side, known[1 - view])
    return known


def shares(total: int, good: float) -> tuple[int, int]:
    """How many bad and good rows a view may label in a round, of ``total`` unlabelled ones."""
    n = max(1, int(ADDED * total))
    return int(round(n * (1 - good))), int(round(n * good))


def fitted(content: Sparse, metadata: Sparse, y: np.ndarray, exchange, seed: int = 3) -> dict | None:
    """The model fitted on labelled rows: weights of both views, their calibrations, and the combination.
    ``exchange(weights, good)`` gives for each view the rows and labels that the other one teaches it next."""
    if len(np.unique(y)) < 2:
        return None
    known = np.arange(len(y))
    random = np.random.default_rng(seed)
    random.shuffle(known)
    held, own = known[: len(known) // 4], known[len(known) // 4 :]
    sizes = (BUCKETS + 11, 1024)
    rows = [x.take(own) for x in (content, metadata)]
    labels = [y[own].astype(float)] * 2
    for round_ in range(ROUNDS + 1):
        weights = [train(rows[view], labels[view], sizes[view], seed + round_) for view in (0, 1)]
        if round_ == ROUNDS:
            break
        for view, (more, given) in enumerate(exchange(weights, y.mean())):
            rows[view] = Sparse.stack([rows[view], more])
            labels[view] = np.append(labels[view], given)
    logits = [x.take(held).dot(w) for x, w in zip((content, metadata), weights)]
    scales = [calibrated(z[:, None], y[held]) for z in logits]
    both = np.column_stack([z * s[0] + s[1] for z, s in zip(logits, scales)])
    return {"weights": [w.astype(np.float32) for w in weights], "scales": scales, "both": calibrated(both, y[held])}


def co_train(content: Sparse, metadata: Sparse, y: np.ndarray, seed: int = 3) -> dict | None:
    """The fitted model for rows in memory; ``y`` is 0 or 1, or -1 for the unlabelled."""
    known, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    both = content.take(pool), metadata.take(pool)
    pick = np.random.default_rng(seed).random(len(pool))
    history = []

    def exchange(weights, good):
        before = taught(history, both, pick)
        cuts = []
        for view in (0, 1):
            z = levels(both[view], weights[view])
            z = z[(before[1 - view] < 0) & (z != 0)]
            cuts.append(cut_of(*np.unique(z >> STEP, return_counts=True), *shares(len(pool), good)))
        history.append((weights, cuts))
        after = taught(history, both, pick)
        new = [np.flatnonzero(a != b) for a, b in zip(after, before)]
        return [(both[view].take(new[view]), after[view][new[view]]) for view in (0, 1)]

    return fitted(content.take(known), metadata.take(known), y[known], exchange, seed)


def scored(model: dict | None, content: Sparse, metadata: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, metadata, combined) probabilities."""
    if model is None:
        return (np.full(len(content), 0.5),) * 3
    z = [x.dot(w) * s[0] + s[1] for x, w, s in zip((content, metadata), model["weights"], model["scales"])]
    w = model["both"]
    return sigmoid(z[0]), sigmoid(z[1]), sigmoid(z[0] * w[0] + z[1] * w[1] + w[2])


FREE = "id IS NOT NULL AND crc32(string(id)) % 5 <> 0"


def features(rows: DataFrame, keys=("view", "y", "id", "k")) -> list[tuple]:
    """(view, y, content, metadata) of rows (view, y, id, k, text, source, lang), each with one row of features; one
    for every value of ``keys``, that of the least k. Texts do not travel: repeats are reduced by their features."""

    def run(batches):
        for batch in batches:
            for piece in row_pieces(batch, 4):
                parts = []
                for x in views(piece, 4, 5, 6):
                    ends = list(zip(x.first[:-1], x.first[1:]))
                    parts.append(pa.array([x.feature[a:b].astype(np.int32).tobytes() for a, b in ends], pa.binary()))
                    parts.append(pa.array([x.value[a:b].astype(np.float32).tobytes() for a, b in ends], pa.binary()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:4], *parts], ["view", "y", "id", "k", "f0", "v0", "f1", "v1"])

    kind = "view int, y int, id long, k long, f0 binary, v0 binary, f1 binary, v1 binary"
    found = rows.select("view", "y", "id", "k", "text", "source", "lang").mapInArrow(run, kind)
    row = F.struct(*[c for c in found.columns if c not in keys])
    least = found.groupBy(*keys).agg(F.min_by(row, "k").alias("row")).select(*keys, "row.*")
    order = [(c, "ascending") for c in ("view", "y", "id", "k")]
    table = least.toArrow().sort_by(order).combine_chunks()  # Arrow all the way: no Python object per value

    def sparse(feature, value):
        feature = np.frombuffer(feature.as_buffer(), np.int32).astype(np.int64)
        return Sparse(np.array([0, len(feature)]), feature, np.frombuffer(value.as_buffer(), np.float32).astype(float))

    columns = [table[c].combine_chunks() if table.num_rows else [] for c in ("f0", "v0", "f1", "v1")]
    return [
        (view, y, sparse(f0, v0), sparse(f1, v1))
        for view, y, f0, v0, f1, v1 in zip(table["view"].to_pylist(), table["y"].to_pylist(), *columns)
    ]


def exchanges(docs: DataFrame, known: DataFrame):
    """The exchange of ``fitted`` over all of ``docs`` that are neither held out nor in ``known``."""
    spark = docs.sparkSession
    history = []

    def exchange(weights, good):
        shared = spark.sparkContext.broadcast((history, weights))

        def run(batches):
            past, latest = shared.value
            for batch in batches:
                for piece in row_pieces(batch, 3):
                    both = views(piece, 3, 4, 5)
                    before = taught(past, both, piece.column(2).to_numpy())
                    columns = [pa.array(levels(x, w)) for x, w in zip(both, latest)] + [pa.array(b < 0) for b in before[::-1]]
                    yield pa.RecordBatch.from_arrays([*piece.columns[:3], *columns], ["id", "k", "pick", "z0", "z1", "free0", "free1"])

        kind = "id long, k long, pick double, z0 long, z1 long, free0 boolean, free1 boolean"
        levelled = docs.filter(FREE).select("id", "k", "pick", "text", "source", "lang").mapInArrow(run, kind)
        pool = stored(levelled.join(known.select("id"), "id", "left_anti"), "co-training")
        both = F.expr("explode(array(struct(0 AS view, z0 AS z, free0 AS free), struct(1 AS view, z1 AS z, free1 AS free)))").alias("e")
        steps = pool.select(both).select("e.view", F.expr(f"shiftright(e.z, {STEP})").alias("step"), F.expr("e.free AND e.z <> 0").alias("usable"))
        # At most 2 * TOP * 1024 steps a view.
        counted = steps.groupBy("view", "step", "usable").count().toArrow()
        of, step, usable, count = (counted[c].to_numpy(zero_copy_only=False) for c in ("view", "step", "usable", "count"))
        total = int(count[of == 0].sum())
        cuts, sets = [], []
        most = int(round(MAX_TAUGHT // ROUNDS * (1 - good)))
        for view in (0, 1):
            own = np.flatnonzero((of == view) & usable.astype(bool))
            own = own[np.argsort(step[own])]
            cut = cut_of(step[own], count[own], *shares(total, good))
            cuts.append(cut)
            at, (low, low_share, high, high_share) = f"shiftright(z{view}, {STEP})", cut
            for y, side, limit in (
                (0, f"z{view} < 0 AND ({at} < {low} OR {at} = {low} AND pick < {low_share!r}D)", most),
                (1, f"z{view} > 0 AND ({at} > {high} OR {at} = {high} AND pick < {high_share!r}D)", MAX_TAUGHT // ROUNDS - most),
            ):
                sets.append(f"IF(free{view} AND {side}, struct({1 - view} AS view, {y} AS y, {limit} AS most), NULL)")
        history.append((weights, cuts))
        taken = pool.select("id", "k", F.expr(f"explode(filter(array({', '.join(sets)}), s -> s IS NOT NULL))").alias("s"))
        taken = taken.select("id", "k", "s.*").distinct()
        # Each task keeps no more than MAX_TAUGHT / ROUNDS rows of a set before they meet.
        by_hash = Window.partitionBy("view", "y").orderBy(F.xxhash64("k", "id", F.lit(len(history))), "id", "k")
        place = taken.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= MAX_TAUGHT // ROUNDS)
        chosen = place.filter("place <= most").select("view", "y", "id", "k")
        # At most 2 * MAX_TAUGHT / ROUNDS rows.
        found = features(docs.join(F.broadcast(chosen), ["id", "k"]))
        discard(pool)
        shared.destroy()
        release(spark)
        out = []
        for view in (0, 1):
            own = [r for r in found if r[0] == view]
            out.append((Sparse.stack([r[2 + view] for r in own]), np.array([r[1] for r in own], float)))
        return out

    return exchange


def model(docs: DataFrame, labels: DataFrame, id_column: str, text: str, source: str, lang: str, label: str) -> dict | None:
    """The model fitted on all documents that are not held out."""
    known = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.filter(f"{FREE} AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    names = ((text, "text"), (source, "source"), (lang, "lang"))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), *[F.col(c).cast("string").alias(n) for c, n in names])
    rows = rows.withColumn("k", F.expr("xxhash64(text IS NULL, text, source IS NULL, source, lang IS NULL, lang)"))
    rows = rows.withColumn("pick", F.expr(f"(xxhash64(id, k) & {(1 << 53) - 1}L) / {1 << 53}D"))
    own = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED).withColumn("view", F.lit(0))
    # Of an id that stands before several texts the one of the least hash counts: no more rows than ids.
    found = features(rows.join(F.broadcast(own), "id"), ("view", "y", "id"))
    content, metadata = (Sparse.stack([r[at] for r in found]) for at in (2, 3))
    return fitted(content, metadata, np.array([r[1] for r in found], np.int64), exchanges(rows, known))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    label: str = "quality",
) -> DataFrame:
    """(doc_id, held_out, content_score, metadata_score, score, predicted, kept) per document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model(docs, labels, id_column, text, source, lang, label))
    names = ["doc_id", "content_score", "metadata_score", "score"]

    def run(batches):
        for batch in batches:
            for piece in row_pieces(batch, 1):
                found = scored(shared.value, *views(piece, 1, 2, 3))
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, found)], names)

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), *[F.col(c).cast("string") for c in (text, source, lang)])
    found = plain.mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double")
    held = F.expr("coalesce(crc32(string(doc_id)) % 5 = 0, false)")
    return found.select("doc_id", held.alias("held_out"), *names[1:], F.expr("int(score >= 0.5)").alias("predicted"), F.expr("score >= 0.5").alias("kept"))
