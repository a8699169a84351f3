"""Spelling variants: words one edit apart, found with a bidirectional FM-index, and the form each belongs to.

Words are runs of letters, counted over all texts. Two words are *near* if one inserted, deleted or replaced code point
turns one into the other. If a word is cut in two, an edit touches one part only: a near word has the other part
unchanged, at its start or at its end. So each word goes, by a hash of either half, to the buckets in which all words of
about its length with the same half are (the halves of lengths one more or less as well). In a bucket all words are
written one after the other between delimiters, and an FM-index of this text and one of its reverse are built. The search
scheme of a half: match it exactly, from the cut outwards to its delimiter, then extend across the other part to that
one's delimiter, with one error. Both suffix-rank intervals are kept in step, so the direction can change at the cut.
All queries of a bucket advance together, as NumPy arrays.

Buckets hold about ``BUCKET_SYMBOLS`` code points of words. A half shared by more than that is dealt into chunks: every chunk
of its words meets every chunk of queries in a bucket of its own, and a query counts only words of the chunk it was sent
to, so each near pair is found once for either word. Near words are reduced to their number and their most frequent one in
the bucket. A word of n code points has fewer than (2n + 1) * (letters) near words, which bounds every group of the joins that
follow forms to their last.

Defined results: a null text has no words; a null id counts as an empty string; repeated rows count as often as they are
there; other columns are ignored; empty tables, or no frequent word, give no rows. A word of any length is searched; a text
is held by Spark's expressions as a whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.llm.session import ship, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
SHORTEST, LEAST, RATIO = 6, 5, 5  # code points of a word, its occurrences, and how much more frequent a form is
TYPO = 199
BUCKET_SYMBOLS = 600_000
QUERIES = 20_000  # searched at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- index ----


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes; the last symbol is smaller than all others."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    span = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for k in range(span):
        key <<= bits
        key[: n - k] |= text[k:]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - span] += rank[span:] + 1
        span *= 2


class Index:
    """Ranks over the Burrows-Wheeler transform of a text, by a wavelet matrix."""

    def __init__(self, text: np.ndarray, symbols: int):
        last = text[suffix_array(text) - 1].astype(np.int32)
        self.size, self.levels = len(text), max(1, (symbols - 1).bit_length())
        self.first = np.searchsorted(np.sort(text), np.arange(symbols + 1))
        self.zeros = []
        for level in reversed(range(self.levels)):
            bit = (last >> level) & 1 == 1
            self.zeros.append(np.append(0, np.cumsum(~bit)).astype(np.int32))
            last = np.concatenate([last[~bit], last[bit]])
        base = np.zeros(symbols, np.int64)
        for level, zeros in zip(reversed(range(self.levels)), self.zeros):
            bit = (np.arange(symbols) >> level) & 1 == 1
            base = np.where(bit, zeros[-1] + base - zeros[base], zeros[base])
        self.base = base

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of the patterns with ``symbol`` put before them, and how many suffixes of the old
        intervals have a smaller symbol there."""
        less = np.zeros(len(low), np.int64)
        for level, zeros in zip(reversed(range(self.levels)), self.zeros):
            bit = (symbol >> level) & 1 == 1
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            less += np.where(bit, b - a, 0)
            low = np.where(bit, zeros[-1] + low - a, a)
            high = np.where(bit, zeros[-1] + high - b, b)
        shift = self.first[symbol] - self.base[symbol]
        return low + shift, high + shift, less

    def branches(self, low: np.ndarray, high: np.ndarray):
        """Every symbol that stands before the suffixes of an interval: (interval, symbol, low, high, less), as
        ``extend`` gives them."""
        of, symbol, less = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for zeros in self.zeros:
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one_low, one_high = zeros[-1] + low - a, zeros[-1] + high - b
            zero, one = b > a, one_high > one_low
            of = np.concatenate([of[zero], of[one]])
            symbol = np.concatenate([symbol[zero] * 2, symbol[one] * 2 + 1])
            less = np.concatenate([less[zero], (less + b - a)[one]])
            low, high = np.concatenate([a[zero], one_low[one]]), np.concatenate([b[zero], one_high[one]])
        shift = self.first[symbol] - self.base[symbol]
        return of, symbol, low + shift, high + shift, less


class Lexicon:
    """Distinct words in code-point order, and the indexes of their delimited text and of its reverse."""

    END, BREAK = 0, 1  # the end of the text, and the delimiter before and after every word

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.alphabet, symbol = np.unique(points, return_inverse=True)
        self.symbol = symbol.astype(np.int64) + 2
        self.start = np.cumsum(self.length) - self.length
        text = np.full(len(symbol) + len(words) + 2, self.BREAK, np.int64)
        text[np.arange(len(symbol)) + np.repeat(np.arange(len(words)), self.length) + 1] = self.symbol
        text[-1] = self.END
        symbols = len(self.alphabet) + 2
        self.forward = Index(text, symbols)
        self.backward = Index(np.append(text[-2::-1], self.END), symbols)

    def word_of(self, rank: np.ndarray) -> np.ndarray:
        """The word whose delimiter starts the suffix of this rank; the last delimiter's suffix comes first."""
        return rank - self.forward.first[self.BREAK] - 1

    def starting_with(self, word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last plus one of the words that start with the first ``size`` code points of some words."""
        low, high = np.zeros(len(word), np.int64), np.full(len(word), self.forward.size)
        for k in range(int(size.max(initial=0)) + 1):
            at = np.flatnonzero((k <= size) & (high > low))
            symbol = np.where(k < size[at], self.symbol[np.maximum(self.start[word[at]] + size[at] - 1 - k, 0)], self.BREAK)
            low[at], high[at], _ = self.forward.extend(symbol, low[at], high[at])
        return self.word_of(low), self.word_of(high)

    def search(self, word: np.ndarray, left: np.ndarray, exact_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word found): words one edit away from ``word``, the edit being in the part after its first
        ``left`` code points if these are the exact part, else among these. Each is found once."""
        inner, outer = (self.forward, self.backward) if exact_left else (self.backward, self.forward)
        start, size = self.start[word], self.length[word]
        exact, rest = (left, size - left) if exact_left else (size - left, left)

        def symbol_at(query, place, of_exact):
            """The symbol of a part, counted from the cut outwards; the delimiter after it."""
            length = exact[query] if of_exact else rest[query]
            to_left = exact_left == of_exact
            at = start[query] + left[query] + (-1 - place if to_left else place)
            return np.where(place < length, self.symbol[np.clip(at, 0, len(self.symbol) - 1)], self.BREAK)

        # Intervals of the same size in both indexes: ``x`` is extended by the exact part, ``y`` by the other.
        query = np.arange(len(word))
        x, y, width = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), np.full(len(word), inner.size)
        done = []
        for k in range(int(exact.max(initial=0)) + 1):
            low, high, less = inner.extend(symbol_at(query, k, True), x, x + width)
            x, y, width = low, y + less, high - low
            # A single suffix is the query's own: no other word has this part.
            over = (exact[query] == k) & (width > 1)
            done.append((query[over], x[over], y[over], width[over]))
            on = (exact[query] > k) & (width > 1)
            query, x, y, width = query[on], x[on], y[on], width[on]
            if not len(query):
                break
        query, x, y, width = (np.concatenate(c) for c in zip(*done)) if done else (query, x, y, width)

        pool = [np.zeros(0, np.int64)] * 5  # with one error: query, place of the next symbol, x, y, width
        found = []
        k = 0
        while len(query) or len(pool[0]):
            new = [[c] for c in pool]

            def add(*columns):
                for held, c in zip(new, columns):
                    held.append(c)

            if len(query):
                want, length = symbol_at(query, np.full(len(query), k), False), rest[query]
                # Deleted: the next symbol is passed over; of a run of equal ones the last.
                can = (k < length) & (symbol_at(query, np.full(len(query), k + 1), False) != want)
                add(query[can], np.full(can.sum(), k + 1), x[can], y[can], width[can])
                of, symbol, low, high, less = outer.branches(y, y + width)
                own, x2 = symbol == want[of], x[of] + less
                other = ~own & (symbol != self.BREAK) & (symbol != self.END)
                replaced = other & (k < length[of])
                add(query[of[replaced]], np.full(replaced.sum(), k + 1), x2[replaced], low[replaced], (high - low)[replaced])
                # Inserted before the next symbol; of a run of equal ones after the last.
                add(query[of[other]], np.full(other.sum(), k), x2[other], low[other], (high - low)[other])
                go = own & (k < length[of]) & (high - low > 1)
                query, x, y, width = query[of[go]], x2[go], low[go], (high - low)[go]
                k += 1
            q, place, px, py, pw = (np.concatenate(c) for c in new)
            low, high, less = outer.extend(symbol_at(q, place, False), py, py + pw)
            ended = (place == rest[q]) & (high > low)
            found.append((q[ended], (px + less if exact_left else low)[ended]))
            on = (place < rest[q]) & (high > low)
            pool = [q[on], place[on] + 1, (px + less)[on], low[on], (high - low)[on]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, rank = (np.concatenate(c) for c in zip(*found))
        near = self.word_of(rank)
        if not exact_left:  # words that also have the left part are found by the other search
            low, high = self.starting_with(word[q], left[q])
            apart = (near < low) | (near >= high)
            q, near = q[apart], near[apart]
        return q, near


# ---- words, buckets, forms ----


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters with ASCII lower case, one code point deleted from those whose checksum with
    the document's id asks for it, of at least SHORTEST code points and LEAST occurrences."""
    runs = docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({RUN})"), F.lit(1))).alias("run"),
    )
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    long_enough = runs.filter(F.length("run") >= SHORTEST).select("doc", run.alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    cut = F.expr("concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    words = long_enough.withColumn("h", h).select(F.when(F.col("h") % TYPO == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= LEAST)


def bucketed(counts: DataFrame, symbols: int) -> DataFrame:
    """The words with their buckets: (bucket, word, n, mark, side, asks, chunk, chunks). ``side`` is 0 for words with a
    common start, 1 for a common end; ``asks`` marks the words that are searched for."""
    # A word of n code points asks with its first n div 2, or the others; near words have a length of n - 1 to n + 1.
    halves = counts.withColumn("n_points", F.length("word")).select(
        "word", "n", "n_points", F.xxhash64(F.lit(7), "word").alias("mark"),
        F.explode(F.expr("""array_distinct(flatten(transform(sequence(n_points - 1, n_points + 1), k -> array(
            struct(0 AS side, k div 2 AS half, k div 2 = n_points div 2 AS asks),
            struct(1 AS side, k - k div 2 AS half, k - k div 2 = n_points - n_points div 2 AS asks)))))""")).alias("part"),
    ).select(
        "word", "n", "mark", "n_points", "part.side", "part.asks",
        F.expr("""xxhash64(part.side, CASE part.side WHEN 0 THEN left(word, int(part.half))
            ELSE right(word, int(part.half)) END)""").alias("key"),
    )
    halves = stored(halves, "spelling-halves")
    sizes = halves.groupBy("key").agg(F.sum(F.col("n_points") + 1).alias("held"))
    large = sizes.filter(F.col("held") > symbols).select("key", F.expr(f"held div {symbols} + 1").alias("chunks"))
    total = halves.agg(F.sum(F.col("n_points") + 1)).first()[0] or 0
    buckets = total // symbols + 1
    # At most total / symbols keys are large: fewer than there are buckets.
    dealt = halves.join(F.broadcast(large) if buckets <= 1 << 16 else large, "key", "left")
    dealt = dealt.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.expr("pmod(mark, chunks)"))
    roles = F.expr("""CASE WHEN chunks = 1 THEN array(struct(0L AS q, 0L AS c, asks AS asks)) ELSE concat(
        transform(sequence(0L, chunks - 1), i -> struct(i AS q, own AS c, false AS asks)),
        IF(asks, transform(sequence(0L, chunks - 1), i -> struct(own AS q, i AS c, true AS asks)), array())) END""")
    dealt = dealt.withColumn("role", F.explode(roles))
    bucket = F.pmod(F.xxhash64("key", "role.q", "role.c"), F.lit(buckets))
    return dealt.select(bucket.alias("bucket"), "word", "n", "mark", "side", "role.asks", F.col("role.c").alias("chunk"), "chunks")


def near_in_bucket(table: pa.Table) -> pa.Table:
    """(word, near, most, form) of the words asked for: how many near words the bucket has for them, and the most
    frequent one (of equals the first in code-point order) with its count."""
    all_words = table["word"].to_pylist()
    words = sorted(set(all_words))
    place = {w: i for i, w in enumerate(words)}
    of = np.array([place[w] for w in all_words], np.int64)
    n, mark = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    n[of], mark[of] = table["n"].to_numpy(), table["mark"].to_numpy()
    side, asks = table["side"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
    chunk, chunks = table["chunk"].to_numpy(), table["chunks"].to_numpy()
    lexicon = Lexicon(words)
    out = []
    for s in (0, 1):
        rows = np.flatnonzero(asks & (side == s))
        for some in np.array_split(rows, len(rows) // QUERIES + 1):
            q, near = lexicon.search(of[some], lexicon.length[of[some]] // 2, s == 0)
            own = mark[near] % chunks[some][q] == chunk[some][q]
            q, near = q[own], near[own]
            order = np.lexsort((near, -n[near], q))
            q, near = q[order], near[order]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
            out.append((of[some][q[first]], np.diff(np.append(first, len(q))), n[near[first]], near[first]))
    word, count, most, form = (np.concatenate(c) for c in zip(*out))
    return pa.table(
        {"word": pa.array([words[i] for i in word], pa.string()), "near": count, "most": most,
         "form": pa.array([words[i] for i in form], pa.string())}
    )


def near_words(counts: DataFrame, symbols: int = BUCKET_SYMBOLS) -> DataFrame:
    """(word, n_near, most, form): how many words are one edit away, and the most frequent of them."""
    ship(counts.sparkSession)
    found = bucketed(counts, symbols).groupBy("bucket").applyInArrow(near_in_bucket, "word string, near long, most long, form string")
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("most"), F.col("best.form").alias("form")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last form reached. Counts rise along forms, so there are no rings; the
    length followed doubles every round."""
    paths = stored(forms.select("word", F.col("form").alias("root")), "spelling-paths")
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(
            paths.join(ahead, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "spelling-paths",
        )
        moved = not longer.filter("moved").isEmpty()
        paths = longer.drop("moved")
        if not moved:
            return paths


def spelling_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", symbols: int = BUCKET_SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word."""
    counts = stored(word_counts(docs, id_column, text), "spelling-words")
    near = stored(near_words(counts, symbols), "spelling-near")
    known = counts.join(near, "word", "left").withColumn("is_form", F.expr(f"coalesce(most >= {RATIO} * n, false)"))
    known = known.select(
        "word", "n", F.expr("coalesce(n_near, 0L) AS n_near"), F.expr("CASE WHEN is_form THEN form END AS form"),
        F.expr("CASE WHEN is_form THEN most END AS form_n"),
    )
    last = roots(known.filter("form IS NOT NULL"))
    joined = known.join(last, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
