"""How two tokenizers cut the same texts: divide and conquer at shared cuts.

Byte offsets at which a token of either tokenizer ends are *shared cuts*; between two neighbouring ones lies a group of
tokens of both. ``shared_ends`` finds them by divide and conquer: a shared cut near the middle of an interval is located by
bisecting one tokenizer's ends for ends of the other, from the middle outwards, and both halves are searched in turn; what
was passed over is not searched again; an interval without a cut inside is a leaf, a group.

A (a byte-level BPE) encodes a space and the text, B (a piece BPE with byte fallback) the text, to which it adds the space
itself. Neither joins a space to what stands before it, so a space after a visible character is a shared cut that is known
without encoding. Texts fall apart there into chunks that repeat; a worker keeps ids and groups of the chunks it has met
(``CHUNKS_KEPT``: memory and speed alone) and encodes new ones many at a call. A chunk's joined token bytes must be a space
and the chunk; a text with a chunk for which they are not has no tokens.

A *link* is a pair of an A token and a B token that end at one offset. Links are counted over all texts per id pair: counts
combine in the tasks before the exchange. Every text is then compared with the counts: the most frequent pairs (at most
``HOT``, a fixed number) are broadcast as two arrays, pairs beyond them are joined, so the table of pairs may be of any size.
Ids and groups are written to the shared folder once; no text is encoded twice.

Defined results: null and empty texts, and those whose bytes do not come back, have no tokens: zeros and an empty digest;
special tokens' strings are plain text; repeated rows count as often as they are there and each keeps its row; a null id stays
null; other columns are ignored; an empty table gives no rows. A text is in memory as a whole, with some 40 bytes a token."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.llm.session import ship, stored
from bitcurve.llm.text import row_pieces

CHUNKS_KEPT = 160_000  # chunks a worker remembers, and as many older ones; only memory and speed depend on it
LONGEST_KEPT = 64  # bytes
CALL = 4096  # chunks encoded by one call
LINKS_AT_ONCE = 1 << 17  # of some rows, looked up together
HOT = 1 << 19  # id pairs whose counts are broadcast, 10 MB; the others are joined
B_IDS = 1 << 16
DIGITS = [str(i) for i in range(B_IDS)]

# A space, not at the end, after a visible ASCII character or one of two bytes that is no white space.
CUT = re.compile(rb"(?<=[\x21-\x7e]) (?!\Z)|(?<=[\xc3-\xdf][\x80-\xbf]) (?!\Z)")


def chunks_of_text(text: bytes | None) -> list[bytes]:
    """The text cut at CUT."""
    if not text:
        return []
    raw = np.frombuffer(text, np.uint8)
    before = raw[np.flatnonzero(raw == 32) - 1]  # of a leading space the last character
    if text[0] != 32 and ((before > 32) & (before < 127)).all() and text[-1] != 32:
        return text.split(b" ")  # every space is a cut
    return CUT.split(text)


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shared ends of two rising arrays of end offsets, as places in ``a`` and in ``b``, in order.

    Both should end at the same offset; that end closes the last group. All intervals of a depth are searched together:
    an interval is the range of ends of ``a`` in which cuts may lie, with the range of ``b`` that its neighbours leave."""
    if not len(a) or not len(b) or a[-1] != b[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = [np.array([[len(a) - 1], [len(b) - 1]])]
    todo = np.array([[0], [len(a) - 1], [0], [len(b) - 1]])
    while True:
        low, high, left, right = todo = todo[:, (todo[0] < todo[1]) & (todo[2] < todo[3])]
        if not len(low):
            break
        middle = (low + high) // 2
        cut, partner, reach = np.full((3, len(low)), -1)
        open_, step = np.arange(len(low)), 0
        while len(open_):  # from the middle outwards, until a cut is found or nothing is left
            for i in (middle[open_] - step, middle[open_] + step) if step else (middle[open_],):
                inside = (i >= low[open_]) & (i < high[open_]) & (cut[open_] < 0)
                own, i = open_[inside], i[inside]
                j = np.searchsorted(b, a[i])
                hit = (j < right[own]) & (j >= left[own])
                own, i, j = own[hit], i[hit], j[hit]
                hit = b[j] == a[i]
                cut[own[hit]], partner[own[hit]], reach[own[hit]] = i[hit], j[hit], step
            more = (cut[open_] < 0) & ((middle[open_] - step > low[open_]) | (middle[open_] + step + 1 < high[open_]))
            open_, step = open_[more], step + 1
        some = cut >= 0
        (low, high, left, right), middle = todo[:, some], middle[some]
        cut, partner, reach = cut[some], partner[some], reach[some]
        found.append(np.stack([cut, partner]))
        # The ends that were passed over on the way to a cut hold none.
        todo = np.hstack([
            np.stack([low, np.where(cut <= middle, cut, middle - reach), left, partner]),
            np.stack([np.where(cut >= middle, cut + 1, middle + reach), high, partner + 1, right]),
        ])
    i, j = np.hstack(found)
    order = np.argsort(i)
    return i[order], j[order]


class Chunk:
    """A chunk's token counts, its groups as text and its links as codes a * B_IDS + b."""

    __slots__ = ("n_a", "n_b", "groups", "links")

    def __init__(self, n_a: int, n_b: int, groups: bytes, links: bytes):
        self.n_a, self.n_b, self.groups, self.links = n_a, n_b, groups, links


class Pair:
    """Both tokenizers of this process and the chunks it knows."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        if self.b.get_piece_size() > B_IDS:
            raise ValueError("too many pieces")
        byte = {c: v for v, c in byte_characters().items()}
        self.a_bytes = {
            i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()
        }
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        self.known: dict[bytes, Chunk | None] = {}
        self.older: dict[bytes, Chunk | None] = {}  # chunks met before ``known`` was begun; those met again move over

    def chunks_of(self, chunks: list[bytes]) -> list[Chunk] | None:
        """The aligned chunks, encoded as one text; None if the bytes do not come back or a chunk's end is no shared cut."""
        joined = b" " + b" ".join(chunks)
        text = joined[1:].decode("utf-8", "replace")
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        ends = []
        for ids, pieces in ((a, self.a_bytes), (b, self.b_bytes)):
            tokens = [pieces[i] for i in ids]
            if b"".join(tokens) != joined:
                return None
            ends.append(np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))))
        i, j = shared_ends(*ends)
        links = np.asarray(a, np.int64)[i] * B_IDS + np.asarray(b, np.int64)[j]
        stop = np.searchsorted(ends[0][i], np.cumsum([len(c) + 1 for c in chunks]))
        if not np.array_equal(ends[0][i][np.minimum(stop, len(i) - 1)], np.cumsum([len(c) + 1 for c in chunks])):
            return None
        a_text, b_text = [DIGITS[v] for v in a], [DIGITS[v] for v in b]
        parts, x, y = [], 0, 0
        for p, q in zip((i + 1).tolist(), (j + 1).tolist()):
            parts.append(f"{a_text[x] if p - x == 1 else ','.join(a_text[x:p])}|{b_text[y] if q - y == 1 else ','.join(b_text[y:q])}")
            x, y = p, q
        n_a, n_b = (np.diff(k[stop] + 1, prepend=0).tolist() for k in (i, j))
        out, at, raw = [], 0, links.tobytes()
        for k, to in enumerate((stop + 1).tolist()):
            out.append(Chunk(n_a[k], n_b[k], ";".join(parts[at:to]).encode(), raw[8 * at : 8 * to]))
            at = to
        return out

    def learn(self, new: list[bytes]) -> None:
        """Align new chunks, many at a call. Those that end with a space would flow into the next one's, and what is odd in
        one chunk must not touch its neighbours: such ones are halved until they are alone."""
        todo = [[c] for c in new if c.endswith(b" ")]
        some = [c for c in new if not c.endswith(b" ")]
        todo += [some[at : at + CALL] for at in range(0, len(some), CALL)]
        while todo:
            chunks = todo.pop()
            found = self.chunks_of(chunks)
            if found is not None:
                self.known.update(zip(chunks, found))
            elif len(chunks) == 1:
                self.known[chunks[0]] = None  # its bytes do not come back
            else:
                todo += [chunks[: len(chunks) // 2], chunks[len(chunks) // 2 :]]

    def align(self, chunks: list[bytes]) -> tuple[int, int, int, str, bytes]:
        """(A tokens, B tokens, groups, digest of the groups, links) of a text by its known chunks."""
        found = [self.known[c] for c in chunks]
        if not found or None in found:
            return 0, 0, 0, "", b""
        digest = hashlib.sha256(b";".join([c.groups for c in found])).hexdigest()
        links = b"".join([c.links for c in found])
        return sum([c.n_a for c in found]), sum([c.n_b for c in found]), len(links) // 8, digest, links

    def align_all(self, texts: list[bytes | None]) -> list[tuple[int, int, int, str, bytes]]:
        if len(self.known) > CHUNKS_KEPT:
            self.known, self.older = {}, self.known
        chunks = [chunks_of_text(t) for t in texts]
        new = set().union(*chunks).difference(self.known)
        again = new & self.older.keys()
        self.known.update((c, self.older[c]) for c in again)
        self.learn(list(new - again))
        out = [self.align(c) for c in chunks]
        for chunk in new:
            if len(chunk) > LONGEST_KEPT:
                del self.known[chunk]
        return out


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable Latin-1,
    else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [v for v in range(256) if v not in own]
    return {v: chr(v) for v in own} | {v: chr(0x100 + i) for i, v in enumerate(rest)}


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    key = (a_path, b_path)
    if key not in _pairs:
        _pairs[key] = Pair(a_path, b_path)
    return _pairs[key]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def aligned(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: a number of its own, token and group counts, digest of its groups, and its links as
    little-endian 64-bit codes; a table in the shared folder."""
    ship(docs.sparkSession)

    def run(batches):
        own = pair(a_path, b_path)
        for batch in batches:
            for rows in row_pieces(batch, 2):
                found = list(zip(*own.align_all(rows.column(2).cast(pa.binary()).to_pylist())))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                columns = [rows.column(0), rows.column(1), *[pa.array(c, t) for c, t in zip(found, types)]]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    plain = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string")
    )
    return stored(plain.mapInArrow(run, ALIGNED), "aligned")


def linked(batches, column: str):
    """(rows, codes, places): some rows of a batch with LINKS_AT_ONCE links together (at least a row), and their links: those of row i
    are codes[places[i]:places[i + 1]]."""
    for batch in batches:
        links = batch.column(column).cast(pa.large_binary())
        _, offsets, data = links.buffers()
        place = np.frombuffer(offsets, np.int64)[links.offset : links.offset + len(links) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(place, place[at] + 8 * LINKS_AT_ONCE, "right")) - 1)
            own = np.frombuffer(data, np.uint8)[place[at] : place[to]] if data is not None else np.zeros(0, np.uint8)
            yield batch.slice(at, to - at), np.frombuffer(own.tobytes(), "<i8"), (place[at : to + 1] - place[at]) // 8
            at = to


def link_counts(table: DataFrame) -> DataFrame:
    """(code, a, b, n, best) of every id pair that is linked anywhere: how often, and whether that is its B id's
    highest count."""

    def run(batches):
        for _, value, _ in linked(batches, "links"):
            value, n = np.unique(value, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], ["code", "n"])

    partial = table.select("links").mapInArrow(run, "code long, n long")
    counts = stored(partial.groupBy("code").agg(F.sum("n").alias("n")), "link-counts")
    b = (F.col("code") % B_IDS).cast("int")
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))  # at most B_IDS rows
    joined = counts.withColumn("b", b).join(F.broadcast(highest), "b")
    return joined.select("code", F.expr(f"int(code div {B_IDS})").alias("a"), "b", "n", (F.col("n") == F.col("top")).alias("best"))


def hot_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, counts, best) of the pairs with at least ``least`` links, sorted by code, and ``least``: the
    smallest number that no more than ``most`` pairs reach, from their numbers per count's leading bits."""
    size = F.expr("64 - length(bin(n))")  # rising as counts fall
    by = {r["size"]: (r["pairs"], r["least"]) for r in counts.groupBy(size.alias("size")).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).collect()}  # at most 64 rows
    held, least = 0, 1 << 62
    for key in sorted(by):
        if held + by[key][0] > most:
            break
        held, least = held + by[key][0], by[key][1]
    found = counts.filter(F.col("n") >= least).select("code", "n", "best").toArrow()
    columns = [found[c].to_numpy(zero_copy_only=False) for c in ("code", "n", "best")]
    order = np.argsort(columns[0], kind="stable")
    return *[c[order] for c in columns], least


def with_link_sums(table: DataFrame, counts: DataFrame, most: int = HOT) -> DataFrame:
    """The rows of ``aligned`` with n_links, n_best (links whose count is their B id's highest) and count_sum."""
    spark = table.sparkSession
    code, n, best, least = hot_pairs(counts, most)
    shared = spark.sparkContext.broadcast((code, n, best.astype(np.int64)))

    def look_up(value):
        known, number, top = shared.value
        if not len(known):
            return np.zeros(len(value), bool), value, value
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        return known[at] == value, number[at], top[at]

    kept = [c for c in table.columns if c != "links"]

    def sums(batches):
        for rows, value, place in linked(batches, "links"):
            hit, number, top = look_up(value)
            total = np.append(0, np.cumsum(np.where(hit, number, 0)))
            many = np.append(0, np.cumsum(np.where(hit, top, 0)))
            own = [pa.array(np.diff(c)) for c in (place, many[place], total[place])]
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in kept] + own, [*kept, "n_links", "n_best", "count_sum"])

    def rest(batches):
        for rows, value, place in linked(batches, "links"):
            hit, _, _ = look_up(value)
            row = np.repeat(rows.column("row").to_numpy(), np.diff(place))[~hit]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(value[~hit])], ["row", "code"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in kept)
    found = table.mapInArrow(sums, f"{types}, n_links long, n_best long, count_sum long")
    rare = counts.filter(F.col("n") < least)
    if not rare.isEmpty():
        own = table.select("row", "links").mapInArrow(rest, "row long, code long").groupBy("row", "code").agg(F.count(F.lit(1)).alias("m"))
        more = own.join(rare, "code").groupBy("row").agg(
            F.sum(F.expr("m * int(best)")).alias("more_best"), F.sum(F.expr("m * n")).alias("more_sum")
        )
        found = found.join(more, "row", "left").withColumns(
            {"n_best": F.expr("n_best + coalesce(more_best, 0)"), "count_sum": F.expr("count_sum + coalesce(more_sum, 0)")}
        )
    return found


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text: str = "text", most: int = HOT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    table = aligned(docs, a_path, b_path, id_column, text)
    summed = with_link_sums(table, stored(link_counts(table), "link-ranks"), most)
    return summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
