import public_tokenizers

from bitcurve.llm import lengths

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_sums_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = brute([r.text for r in docs.select("text").collect()])
    sums = lengths.with_suffix_sums(lengths.histogram(docs, PATH)).cache()
    rows = sums.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(sizes))
    for r in rows:
        n = r.n_tokens
        assert r.n_docs == sizes.count(n)
        assert r.docs_from == sum(s >= n for s in sizes) and r.docs_below == sum(s < n for s in sizes)
        assert r.tokens_from == sum(s for s in sizes if s >= n)
        assert r.truncated_total == sum(min(s, n) for s in sizes)
        assert r.lost_total == sum(max(0, s - n) for s in sizes)
        assert abs(r["quantile"] - sum(s <= n for s in sizes) / len(sizes)) < 1e-12
    for r in lengths.at_limits(sums, [1, 100, 512, 2048, 10**6]).collect():
        assert r.truncated_total == sum(min(s, r.context_limit) for s in sizes)
        assert r.lost_total == sum(max(0, s - r.context_limit) for s in sizes)
    for r in lengths.quantiles(sums, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == sorted(sizes)[max(0, -(-int(r.p * len(sizes) * 1000) // 1000) - 1)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None,), ("",), ("one two",), ("one two",)], "text string")
    rows = lengths.with_suffix_sums(lengths.histogram(docs, PATH)).collect()
    assert sorted((r.n_tokens, r.n_docs, r.docs_from, r.truncated_total) for r in rows) == [(0, 2, 4, 0), (2, 2, 2, 4)]
    assert lengths.with_suffix_sums(lengths.histogram(docs.limit(0), PATH)).count() == 0
