import zlib

import numpy as np
import public_tokenizers
import pytest

from bitcurve.llm import records
from bitcurve.session import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(rows, tokenizer):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_of_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(map(tuple, records.record_digests(spark, docs, PATH).collect()))
    assert got == expected(rows, tokenizer)


def test_odd_rows(spark, tokenizer):
    texts = [(3, ""), (1, None), (2, "a\x1cb c d <|endoftext|>x É́ ΣΑΣ It's 1234"), (2, "w" * 5000), (2, "w" * 5000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, file string, part string")
    got = sorted(map(tuple, records.record_digests(spark, docs, PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1, 2, 2, 2, 3]
    assert got[1][1] == 1 and got[-1][2] == 1
    plain = {(i, n, c) for i, _, n, c in expected(texts, tokenizer)}
    assert {(i, n, c) for i, _, n, c in got} == plain
    assert records.record_digests(spark, docs.limit(0), PATH).count() == 0


def test_null_ids_and_shuffled_reads(spark, tokenizer):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, "three"), (4, "four five")], "doc_id long, text string")
    folder = scratch(spark, "records-test")
    index = records.write_records(docs, folder, PATH)
    got = records.read_shuffled(index, folder, 7).collect()
    want = [(i, [*tokenizer.encode(t, add_special_tokens=False).ids, 1]) for i, t in map(tuple, docs.collect())]
    assert sorted(map(str, [(r.doc_id, list(r.ids)) for r in got])) == sorted(map(str, want))
    assert [tuple(r) for r in got] == [tuple(r) for r in records.read_shuffled(index, folder, 7).collect()]


def test_damage_is_noticed():
    import io

    data = bytearray(records.frame(records.payload_of(1, b"\x01\x00\x02\x00", 2)))
    assert records.unpack(records.read_frame(io.BytesIO(bytes(data))))[1].tolist() == [1, 2]
    data[-6] ^= 1
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(bytes(data)))
