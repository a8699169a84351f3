import zlib

import numpy as np
import pyarrow as pa
import pytest

from bitcurve.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_on_held_out_documents(spark, docs, labels):
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    own = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    toxic = [p for p, t in own if t == 1]
    clean = [p for p, t in own if t == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03  # some 320 toxic texts to learn from


def test_toxicity_finds_unseen_misspellings():
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("etaoinsr"), 5)) for _ in range(200)]
    bad = ["wretchedness", "scoundrel", "blockhead"]

    def text(n, extra):
        return " ".join([*rng.choice(plain, n), *extra, *rng.choice(plain, n)])

    texts = [text(30, []) for _ in range(150)] + [text(30, [str(rng.choice(bad))]) for _ in range(150)]
    weight, bias = toxicity.fit(pa.array(texts), np.repeat([0.0, 1.0], 150))
    probe = pa.array([text(400, ["scoundrell"]), text(5, ["blokhead"]), text(400, []), text(5, []), "", None, "..."])
    s = toxicity.scores(probe, weight, bias)
    assert (s[:2] > 0.5).all() and (s[2:] < 0.5).all() and (s[4:] == 0).all()


def test_odd_rows(spark, labels):
    rows = [(1, None, None, None), (2, "", "s", "en"), (None, "idiot words here", "s", "en"), (None, "idiot words here", "s", "en"), (5, "x" * 100_000, "s", "")]
    docs = spark.createDataFrame([(*r, 0.1, 2) for r in rows], "doc_id long, text string, source string, lang string, score double, id int")
    some = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 1, 0), (None, 1, 1), (3, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for found in (toxicity.score_documents(docs, some), quality.quality_scores(docs, some)):
        got = found.collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    assert toxicity.without_toxic(docs, some).columns == docs.columns
    for none in (docs.limit(0),):
        assert toxicity.score_documents(none, some).count() == 0
        assert quality.quality_scores(none, some).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, some.limit(0)).collect()} == {0.0}


def test_quality_on_held_out_documents(spark, docs, labels):
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    own = [(r, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.kept for r, t in own if t == 1]) > 0.97
    assert np.mean([r.kept for r, t in own if t == 0]) < 0.1
    assert np.mean([(r.metadata_score >= 0.5) == (t == 1) for r, t in own]) > 0.85


def test_views_teach_each_other():
    """A few labels and two views that each show the class: co-training must beat the views alone."""
    rng = np.random.default_rng(2)
    n = 1200
    y = rng.integers(0, 2, n)

    def view(strength):
        feature = np.where(rng.random(n) < strength, y, 1 - y) * 20 + rng.integers(0, 20, n)
        return quality.Sparse(np.arange(0, 3 * n + 1, 3), np.stack([feature, feature % 20 + 600, np.full(n, 1023)], 1).ravel(), np.ones(3 * n))

    content, metadata = view(0.97), view(0.9)
    given = np.where(rng.random(n) < 0.05, y, -1)
    model = quality.co_train(content, metadata, given)
    best = ((quality.scored(model, content, metadata)[2] >= 0.5) == y).mean()
    own = np.flatnonzero(given >= 0)
    alone = quality.train(content.take(own), y[own].astype(float), quality.BUCKETS + 11, 1)
    assert best > ((content.dot(alone) > 0) == y).mean()


def test_views_exchange_labels_over_all_unlabelled_documents(spark):
    """A word that only documents late in hash order have is learnt through their sources."""
    from pyspark.sql import functions as F

    ids = spark.range(11_000).filter("crc32(string(id)) % 5 <> 0").orderBy(F.xxhash64("id")).limit(8_000).collect()
    ids = [r.id for r in ids]
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(200)]

    def row(i, word, source):
        return (i, " ".join([*rng.choice(words, 20), *[word] * 10]), source, "en")

    late = {i: k % 2 for k, i in enumerate(ids[6_900:])}
    rows = [row(i, ("theta", "zetas")[late[i]], ("bad", "good")[late[i]]) if i in late else row(i, ("awful", "great")[i % 2], "other") for i in ids]
    known = [(100_000 + i, i % 2) for i in range(1_200)]
    rows += [row(i, ("awful", "great")[y], ("bad", "good")[y]) for i, y in known]
    rows += [row(200_000, "zetas", "other"), row(200_001, "theta", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    found = {r.doc_id: r.content_score for r in quality.quality_scores(docs, labels).filter("doc_id >= 200000").collect()}
    assert found[200_000] > 0.9 and found[200_001] < 0.1


def test_toxicity_learns_from_words_late_in_long_texts():
    """The telling words of all toxic texts lie beyond word 400, in pieces of several sizes."""
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("etaoinsr"), 5)) for _ in range(200)]
    texts = [" ".join([*rng.choice(plain, 450), *["scoundrel"] * 40 * y]) for y in np.repeat([0, 1], 60)]
    vocabulary = toxicity.Vocabulary(pa.array(texts))
    seen = []
    whole = toxicity.pieces

    def spy(v, first, words):
        seen.append(int(words.sum()))
        return whole(v, first, words)

    toxicity.pieces = spy
    try:
        weight, bias = toxicity.fit(pa.array(texts), np.repeat([0.0, 1.0], 60))
    finally:
        toxicity.pieces = whole
    assert seen[0] == len(vocabulary.code)  # the first batch: all words of all 120 texts
    s = toxicity.scores(pa.array(["scoundrel", " ".join(plain[:50])]), weight, bias)
    assert s[0] > 0.5 > s[1]
