"""Source divergence, clustering and toxicity against brute force, SQL and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import rows, table
from voltlake.llm import divergence, drake, queries, toxicity

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ---- 11


def brute_divergence(data, top=200):
    groups, found, df = set(), defaultdict(Counter), Counter()
    for _, text, lang, source, _ in data:
        lang, source, words = lang or "", source or "", TERM.findall(low(text or ""))
        groups.add((lang, source))
        found[lang, source].update(words)
        df.update((lang, w) for w in set(words))
    kept = defaultdict(set)
    for (lang, w), n in df.items():
        if n >= 3:
            kept[lang].add(w)

    def ps(lang, count):
        words, n = kept[lang], sum(count[w] for w in kept[lang])
        return {w: 1 + 10**9 * (count[w] + 1) // (n + len(words)) for w in words}

    p = {g: ps(g[0], found[g]) for g in groups}
    q = {lang: ps(lang, sum((found[g] for g in groups if g[0] == lang), Counter())) for lang in {g[0] for g in groups}}
    f = lambda a, b: (a - b) ** 2 // b
    out = []
    for g in groups:
        pair = [(o[1], sum(f(p[g][w], p[o][w]) for w in kept[g[0]])) for o in groups if o[0] == g[0] and o != g]
        term = [(w, f(p[g][w], q[g[0]][w])) for w in kept[g[0]] if found[g][w] and p[g][w] > q[g[0]][w]]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(*g, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


def got_divergence(df, **kw):
    return sorted(tuple(r) for r in divergence.divergence(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("clash", "kw"), [(False, {}), (True, {"head_terms": 0, "block_terms": 40}), (False, {"head_terms": 60, "block_terms": 300})])
def test_divergence(spark, clash, kw, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    assert got_divergence(table(spark, clash=clash), **kw) == brute_divergence(rows())


def test_divergence_hot_and_without_terms(spark):
    data = [(k, "alpha beta Alpha éa-b", "en", "hot", 1) for k in range(300)] + [(k, t, "en", s, 1) for k, (t, s) in enumerate([(None, "none"), ("12 34", "digits"), ("beta gamma", ""), ("beta", None)])]
    data += [(1, "rare words only", "fr", "a", 1), (2, "", "fr", "b", 1), (3, "x", None, None, 1)]
    assert got_divergence(table(spark, data)) == brute_divergence(data)
    assert got_divergence(table(spark, [])) == []


# ---- 12


def brute_clusters(data, k=40, rounds=5):
    vectors = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        at = [min((far(v, m), j) for j, m in enumerate(c)) for _, v in vectors]
        if r < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), a in zip(vectors, at) if a[1] == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    most = (1 << 63) - 1
    own, total = Counter(), sum(d for d, _ in at)
    for d, j in at:
        own[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, j, min(d, most), min(own[j], most), min(total, most), sha[j]) for (i, _), (d, j) in zip(vectors, at))


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("distance", F.lit("y")).repartition(3)


def awkward(seed, n, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, 64))
    data = [(k, (centres[k % 25] + spread * rng.normal(size=64)).tolist()) for k in range(n)]
    data += [(7, data[3][1]), (8, data[3][1])] + [(1000 + k, [0.5] * 64) for k in range(n // 2)]  # repeated ids and vectors
    data += [(None, data[5][1]), (2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63)]
    return data


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 400, 0.05), (2, 300, 1.0), (3, 60, 0.0), (4, 20, 1.0)])
def test_clusters(spark, seed, n, spread):
    data = awkward(seed, n, spread)
    assert Counter(tuple(r) for r in drake.cluster(vectors(spark, data)).collect()) == brute_clusters(data)


def test_clusters_of_far_components(spark):
    data = awkward(5, 80) + [(3000, [1e6] * 64), (3001, [-3e9] * 64), (3002, [1e15] * 64)]
    assert Counter(tuple(r) for r in drake.cluster(vectors(spark, data)).collect()) == brute_clusters(data)


def test_bounds_spare_and_empty(spark):
    rng = np.random.default_rng(6)
    data = [(k, (10 * np.eye(64)[k % 30] + 0.01 * rng.normal(size=64)).tolist()) for k in range(600)]
    report = []
    got = Counter(tuple(r) for r in drake.cluster(vectors(spark, data), k=6, report=report).collect())
    assert got == brute_clusters(data, k=6)
    assert min(needed for _, needed in report[1:]) == 0 and min(w for w, _ in report) >= 1
    assert drake.cluster(vectors(spark, [(1, None)])).count() == 0


def test_bounds_hold():
    """After moves every lower bound is at most the true distance, and the own centroid is the nearest."""
    rng = np.random.default_rng(7)
    x, c = np.floor(rng.normal(size=(500, 64)) * 256), np.floor(rng.normal(size=(40, 64)) * 256)
    b = drake.Bounds(500, 10, c)
    b.scan(x, np.arange(500))
    for width in (10, 8, 5):
        new = c + np.floor(rng.normal(size=c.shape) * 3)
        n = drake.Bounds(500, width, new)
        n.move(x, b.own, b.near, b.lower, b.rest, np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-12))
        d2 = drake.squares(x, new)
        assert (n.own == d2.argmin(1)).all() and (n.d2 == d2.min(1)).all()
        d = np.sqrt(d2)
        assert (n.lower <= np.take_along_axis(d, n.near, 1)).all()
        others = d.copy()
        np.put_along_axis(others, np.c_[n.own[:, None], n.near], np.inf, 1)
        assert (n.rest <= others.min(1)).all()
        b, c = n, new


# ---- 13


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model)
    met = got.join(labels, "doc_id").where("held_out and toxic is not null").select("toxic", "predicted", "score").collect()
    n = Counter((r.toxic, r.predicted) for r in met)
    assert n[1, 1] >= 0.88 * (n[1, 1] + n[1, 0]) and n[0, 1] <= 0.005 * (n[0, 0] + n[0, 1])
    assert got.count() == docs.count()
    found = toxicity.offending(docs, model).join(docs, "doc_id").selectExpr("doc_id", "sentence = substring(text, int(start + 1), int(end - start)) AS placed").collect()
    assert found and all(r.placed for r in found)
    with_sentences = {r.doc_id for r in found}
    assert with_sentences == {r.doc_id for r in got.where("n_offending > 0").select("doc_id").collect()}


def made_up(n=400):
    """Toxic documents have one bad sentence each; labels aren't held out but for a fifth."""
    rng = np.random.default_rng(8)
    pool = [f"{a}{b}" for a in "ba ce di fo gu".split() for b in "lan mer tik sop rud".split()]
    docs, labels = [], []
    for k in range(n):
        lines = [" ".join(rng.choice(pool, 8)) for _ in range(6)]
        bad = k % 4 == 0
        if bad:
            lines[k % 6] = f"you {rng.choice(['vile', 'Rotten', 'foul'])} {lines[k % 6]}"
        docs.append((k, ". ".join(lines) + ".", "en", "s", 1))
        labels.append((k, None, int(bad)))
    return docs, labels


LABEL = "doc_id long, quality int, toxic int"


def test_toxicity_finds_sentences(spark):
    docs, labels = made_up()
    model = toxicity.train(table(spark, docs), spark.createDataFrame(labels, LABEL))
    got = toxicity.scored(table(spark, docs, clash=True), model).collect()
    assert sorted(r.doc_id for r in got if r.predicted) == [k for k, _, y in labels if y] and sum(r.held_out for r in got) > 20
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    spans = toxicity.offending(table(spark, docs), model).collect()
    assert all(re.match(r" ?you (vile|Rotten|foul)", r.sentence) for r in spans) and {r.doc_id for r in spans} == {k for k, _, y in labels if y}
    again = toxicity.scored(table(spark, docs, parts=7), toxicity.train(table(spark, docs, parts=5), spark.createDataFrame(labels, LABEL).repartition(4))).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_toxicity_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = made_up()
    turned = [(k, q, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, q, y in labels]
    moved = [(k, t, "xx", "toxic" if y else "other", 9) for (k, t, *_), (_, _, y) in zip(docs, labels)]
    a = toxicity.toxicity(table(spark, docs), spark.createDataFrame(labels, LABEL)).collect()
    b = toxicity.toxicity(table(spark, moved), spark.createDataFrame(turned, LABEL)).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_toxicity_awkward(spark):
    docs, labels = made_up()
    labels += [(None, 1, 1), (3, 1, None), (5, 1, 7), (10**12, 1, 1)]
    extra = rows() + [(9000, "x" * 100_000, "en", "s", 1), (9001, "word " * 200_000 + "you vile foul", "en", "s", 1)]
    got = toxicity.toxicity(table(spark, docs + extra, clash=True), spark.createDataFrame(labels, LABEL)).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(r.score == 0 and r.predicted == 0 and r.worst_start is None for r in got if r.n_sentences == 0) and any(r.n_sentences == 0 for r in got)
    assert [r.predicted for r in got if r.doc_id == 9001] == [1]
    none = toxicity.toxicity(table(spark, docs[:30]), spark.createDataFrame([], LABEL)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.toxicity(table(spark, []), spark.createDataFrame(labels, LABEL)).count() == 0


def test_noisy_or():
    assert toxicity.noisy_or([]) == 0 and toxicity.noisy_or([0.5, 0.5]) == pytest.approx(0.75) and toxicity.noisy_or([1e-18] * 3) == pytest.approx(3e-18)
    cut = [x[:2] for x in toxicity.sentences("ab " * 300 + "。cd! 12. ef\ngh")]
    assert cut[-3:] == [(901, 903), (908, 911), (912, 914)] and max(b - a for a, b in cut) <= toxicity.LONGEST


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert Counter(map(tuple, queries.QUERIES[name](spark, SF).select(*columns).collect())) == Counter(want.fetchall())


def test_p_of_many_occurrences(spark):
    """Beyond what a long product holds."""
    data = [(0, 1), (8_999_999_999, 10**12), (9_000_000_000, 10**13 + 7), (10**15, 3 * 10**15), (10**18, 10**18)]
    got = spark.createDataFrame(data, "n long, size long").select("n", "size", divergence._p("n", "size").alias("p")).collect()
    assert {(r.n, r["size"]): r.p for r in got} == {(n, s): 1 + 10**9 * (n + 1) // s for n, s in data}
