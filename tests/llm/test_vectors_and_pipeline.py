import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from arborinfo.llm import embedding_dedup as ed
from arborinfo.llm import language_mixture, lattice, pii
from arborinfo.llm.components import components
from arborinfo.llm.pieces import tokenizer

SMALL = "/root/testdata/sf0.001"


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 440)]
    pairs += [(500, 501 + k) for k in range(50)] + [(7, 7), (None, 3)]
    union = brute.Union(range(600))
    for a, b in pairs[:-1]:
        union.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: union.find(x) for x in range(600) if union.find(x) != x}


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 20)  # so that hot keys are dealt out as pairs of blocks
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    rows = []
    for k in range(260):
        v = base[0] if k < 90 else base[k % 60]
        rows.append((k, (v + rng.choice([0, 0.1, 0.2, 0.35]) * rng.normal(size=24)).tolist(), k % 2 if k >= 90 else 0))
    odd = [None, [0.0] * 24, [float("nan")] * 24, [None] * 24, [], [1.0, 0.0], [1.0, 0.1], [1.0, -0.0]]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(2000, [1.0, 0.0], None), (2001, rows[5][1], 0), (None, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    unit = [
        None if v is None or lab is None or not v or any(x is None or not np.isfinite(x) for x in v) or not np.any(v)
        else np.array(v) / np.linalg.norm(v) for _, v, lab in rows
    ]
    union, links = brute.Union(range(len(rows))), np.zeros(len(rows), int)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] >= 0.93:
                    links[[i, j]] += 1
                    union.join(i, j)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_vectors(df).collect()}
    want = {}
    for i, (vec, _, _) in enumerate(rows):
        root = rows[union.find(i)][0]
        want[vec] = (links[i], root, vec == root)
    missed = [v for v in want if want[v] != got[v]]
    assert len(got) == len(rows) and len(missed) <= 0.01 * len(rows), missed
    assert all(got[v][0] <= want[v][0] for v in want)
    assert ed.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_bound():
    rng = np.random.default_rng(3)
    x = ed.unit(rng.normal(size=(4000, 64)))
    z = rng.normal(size=x.shape)
    z = ed.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = ed.unit(0.93 * x + np.sqrt(1 - 0.93**2) * z)
    a, b = (ed.bucket_codes(v, ed.TABLES, ed.HASHES, ed.PROBES) for v in (x, y))
    met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=(1, 2))
    assert met.mean() > 0.999


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {d: t for d, t in texts.items() if any(c.isalpha() for c in t or "")}
    texts = {d: texts[d] for d, (_, c) in brute.jaccard_components(texts).items() if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    marks = {d: brute.contaminated(t, items) for d, t in texts.items()}
    assert set(out) == {d for d in texts if not marks[d][4]}
    decode = lattice.decoder_of(tokenizer())
    for d, r in out.items():
        assert r.restored and r.n_chars == len(decode(r.ids))
        if not marks[d][1] and not any(c in texts[d] for c in "0123456789@"):
            assert decode(r.ids) == texts[d]
        assert brute.base_spans(decode(r.ids)) == ""


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("n_words", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs.filter("doc_id < 60"), SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"]
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
