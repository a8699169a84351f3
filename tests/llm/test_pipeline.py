import __spark_entry__
import corpus_pipeline as P
import public_tokenizers
import pytest
from test_decontaminate import brute as contaminated
from test_packing import brute_lengths
from test_sentence_spans import brute as cut
from test_signature_tree import groups

from bitcurve.llm import toxicity
from bitcurve.llm.session import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(stages):
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns and frame.dtypes == stages[0].dtypes


def test_toxicity(spark, stages):
    scores = toxicity.score_documents(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(texts(stages[1])) == {r.doc_id for r in scores if r.predicted == 0}
    assert 0 < stages[1].count() < stages[0].count()


def test_near_duplicates(stages):
    before = sorted(texts(stages[1]).items())
    _, roots = groups([t for _, t in before])
    assert texts(stages[2]) == {before[i][0]: before[i][1] for i in set(roots)}
    assert stages[2].count() < stages[1].count()


def test_substring_dedup(spark, stages):
    from pyspark.sql import functions as F

    rows = stages[2].select("doc_id", F.xxhash64("text"), "text", "n_chars").collect()
    want = cut([tuple(r)[:3] for r in rows])
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[3].collect()}
    assert got == {r.doc_id: (t, len(t) if n else r.n_chars) for r, (t, n) in zip(rows, want)}


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = sorted(texts(stages[3]).items())
    bad = {int(r[0]) for r in contaminated(docs, items) if r[5]}
    assert texts(stages[4]) == {i: t for i, t in docs if i not in bad}


def test_packing(stages):
    rows = stages[4].collect()
    packed = stages[5].collect()
    lengths = dict(zip([r.doc_id for r in rows], brute_lengths([r.text for r in rows])))
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == lengths
    bins = {}
    for r in packed:
        bins.setdefault(r.bin_id, []).append(r)
    assert all(sum(r.n_tokens for r in own) <= 2048 and len({r.source for r in own}) == len(own) for own in bins.values())


def test_run_and_registration(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    names = __spark_entry__.queries()
    assert {"pipeline"} < set(names) and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert P.run(spark, SF).count() > 100
    assert public_tokenizers.path("word_bpe_49k.json")
