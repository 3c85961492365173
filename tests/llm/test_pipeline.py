"""The stages one after the other over the supplied documents, and the registered queries."""

from collections import Counter, defaultdict

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    from voltlake.llm.common import shared_path

    docs, out = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = shared_path(spark, name)
        f(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs, new))
        docs = new
    return out


def test_columns_and_order(stages):
    assert [n for n, *_ in stages] == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "pack"]
    assert all(new.columns == old.columns for _, old, new in stages[:-1])


def test_decisions_take_effect(stages, spark):
    from tests.llm.test_documents import brute_base, brute_components, brute_quality

    (_, raw, kept), (_, _, unique), (_, before, clean), (_, _, mixed), (_, packed_of, packed) = stages
    for r in raw.collect():
        n, *_, repeat = brute_quality(r.text)
        if n < 50 or 100 * repeat > 50 * n:
            assert kept.where(kept.doc_id == r.doc_id).isEmpty()
    comps = brute_components([tuple(r) for r in kept.collect()])
    assert sorted(r.doc_id for r in unique.collect()) == sorted({c for *_, c in comps})
    old = {r.doc_id: r.text for r in before.collect()}
    new = {r.doc_id: r for r in clean.collect()}
    assert set(old) == set(new) and all(r.n_chars == len(r.text) for r in new.values() if "[SECRET]" in r.text)
    assert all(not brute_base(r.text) for r in new.values()) and any(brute_base(t) for t in old.values())
    assert all(new[i].text == t for i, t in old.items() if not brute_base(t))
    words = Counter()
    for r in clean.collect():
        words[r.source] += len(r.text.split())
    assert sum(len(r.text.split()) for r in mixed.collect()) == pytest.approx(1.5 * sum(words.values()), rel=0.15)
    per = defaultdict(int)
    for r in packed.collect():
        per[r.doc_id] += r.length
    assert set(per) == {r.doc_id for r in packed_of.collect()}


@pytest.mark.parametrize("n", range(1, 11))
def test_queries_run(spark, n):
    from voltlake.llm.queries import QUERIES

    (f,) = [f for k, f in QUERIES.items() if k.startswith(f"op{n}_")]
    assert not f(spark, SF).isEmpty()
