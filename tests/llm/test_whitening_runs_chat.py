import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborinfo.functions.rng import mix64
from arborinfo.llm import chat_format as cf
from arborinfo.llm import periodic_runs as pr
from arborinfo.llm import whitening as wh
from arborinfo.llm.queries import op13_chat_format

ROWS = "vec_id long, embedding array<double>, label int, n long, component string"


def whole(v):
    return [int(np.floor(64 * c)) + 1_000_000 for c in v]


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


@pytest.mark.parametrize("scale", [1.0, 1e-6])
def test_whitening_is_the_eigen_decomposition(spark, scale):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(9, 9)) @ np.diag([5, 3, 2, 1, 1, 1, 0.5, 0.5, scale * 1e3])
    rows = [(k, (rng.normal(size=9) @ mix).tolist(), 1, 2, "x") for k in range(400)]
    rows += [(5, rows[5][1], 1, 2, "x"), (None, rows[6][1], 1, 2, "x"), (900, None, 1, 2, "x"), (901, [1.0] * 8 + [None], 1, 2, "x")]
    rows += [(902, [float("nan")] + [0.0] * 8, 1, 2, "x"), (903, [float("inf")] * 9, 1, 2, "x"), (904, [], 1, 2, "x")]
    got = wh.whiten(spark.createDataFrame(rows, ROWS).repartition(5), k=7).toPandas()
    kept = [(k, v) for k, v, *_ in rows if usable(v) and v]
    x = np.array([whole(v) for _, v in kept], object)
    n, total = len(x), x.sum(axis=0)
    deviations = n * x - total
    a = (deviations / n).astype(float)
    value, vector = np.linalg.eigh(a.T @ a / n)
    value, vector = value[::-1], vector[:, ::-1]
    assert len(got) == 7 * n and set(got.component) == set(range(1, 8)) and (got.n == n).all()
    assert (got.identity_error < 1e-9).all() and got.identity_error.nunique() == 1
    for i, (key, _) in enumerate(kept):
        if key is None or key == 5:
            continue
        mine = got[got.vec_id == key].sort_values("component")
        assert (mine.deviation == sum(d * d for d in deviations[i])).all()
        assert np.allclose(mine.explained, value[:7] / value.sum(), rtol=1e-9)
        assert np.allclose(np.abs(mine.whitened), np.abs(a[i] @ vector[:, :7]) / np.sqrt(value[:7]), atol=1e-7)
    assert len(got[got.vec_id == 5]) == 14 and got.vec_id.isna().sum() == 7


def test_whitening_of_dependent_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-50, 50, (60, 3))
    rows = [(k, [*map(float, b), float(b.sum()), 7.0], 0, 0, "") for k, b in enumerate(base)]
    rows += [(100 + k, [0.5, 0.25], 0, 0, "") for k in range(3)] + [(200, [1.0], 0, 0, "")]
    rows += [(300, [1e12, 0.0, 3.0, -1.0], 0, 0, ""), (301, [-1e12, 0.0, 2.0, 5.0], 0, 0, "")]
    df = spark.createDataFrame(rows, ROWS)
    got = wh.whiten(df).toPandas()
    five = got[got.vec_id < 100]
    assert set(five[five.whitened.notna()].component) == {1, 2, 3} and len(five) == 300
    assert (got.identity_error < 1e-6).all() and five[five.component > 3].explained.max() < 1e-20
    same = got[(got.vec_id >= 100) & (got.vec_id <= 200)]
    assert same.whitened.isna().all() and same.explained.isna().all() and (same.deviation == 0).all() and len(same) == 7
    wide = got[got.vec_id >= 300]
    assert wide.deviation.isna().all() and wide[wide.component == 1].whitened.abs().round(6).tolist() == [1.0, 1.0]
    assert wh.whiten(df.limit(0)).count() == 0 and wh.whiten(df.where("vec_id is null")).count() == 0


def test_orthogonality_of_ill_conditioned_rows():
    """The factors of the passes, as against one Cholesky factor, at a condition number of 1e10."""
    rng = np.random.default_rng(3)
    left, right = np.linalg.qr(rng.normal(size=(300, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    sizes = np.logspace(0, -10, 6)
    a, rows, factors = left * sizes @ right, None, []
    rows = a
    for k in range(wh.PASSES):
        factors.append(wh.factor(rows.T @ rows, k == 0))
        rows = wh.solved(rows, factors[-1], step=4)
    assert np.abs(rows.T @ rows - np.eye(6)).max() < 1e-13
    fit = wh.finished(wh.Fit(300, [0] * 6, True, factors))
    assert np.allclose(np.sqrt(fit.variance * 300), sizes, rtol=1e-4) and fit.rank == 6
    squared = np.sqrt(np.abs(np.linalg.eigvalsh(a.T @ a)))  # what the Gram matrix alone knows
    assert not np.isclose(squared.min(), sizes[-1], rtol=1e-3, atol=0)


def brute_runs(w):
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        j = 0
        while j + q < n:
            s = j
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > s and j + q - s >= max(24, 3 * q):
                out.setdefault((s, j + q), q)
            j += j == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


def some_words(rng):
    kind, w = rng.randint(0, 5), []
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(rng.randint(0, 400))]
    if kind == 1:
        return [0] * rng.randint(0, 700)
    if kind == 2:
        for _ in range(rng.randint(1, 4)):
            p = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 150))]
            w += (p * 8)[: rng.randint(1, 8 * len(p))]
        return w
    if kind == 3:
        p = [0] * rng.randint(1, 30) + [1]
        return (p * 20)[: rng.randint(1, 20 * len(p))]
    if kind == 4:
        a, b = [0], [0, 1]
        while len(b) < 500:
            a, b = b, b + a
        return b
    return [rng.randint(0, 3) for _ in range(5)] * rng.randint(1, 60) + [rng.randint(0, 9) for _ in range(200)] * rng.randint(1, 4)


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_all_runs(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(pr, "WIDEST", 64 if seed % 2 else 16)  # wide scales through their first words
    texts = [some_words(rng) for _ in range(rng.randint(1, 12))]
    flat = np.array([x for w in texts for x in w], np.uint64)
    found, counts = pr.runs_of_words(mix64(flat), np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64))
    for k, w in enumerate(texts):
        assert [tuple(r) for r in found[counts[k] : counts[k + 1]].tolist()] == brute_runs(w)


def test_zero_distances_are_exact():
    rng = np.random.default_rng(4)
    value = np.concatenate([np.where(np.arange(600) % 50 < 30, np.arange(600) % 5, rng.integers(0, 3, 600)) * 1234567 % pr.PRIME, np.zeros(128)]).astype(np.float64)
    square = np.concatenate([[0], np.cumsum(value.astype(np.int64) ** 2 % pr.PRIME)])
    begin = np.arange(0, 520, 8)
    row, shift = pr.zero_distances(value, square, begin, begin + 3, 8)
    want = [(k, s) for k, b in enumerate(begin) for s in range(8) if (value[b : b + 8] == value[b + 3 + s : b + 11 + s]).all()]
    assert list(zip(row, shift)) == want and len(want) > 0


def test_periodic_texts(spark):
    period = "the cat  sat\ton a mat "
    long = "w " * 30_000 + "x"
    rows = [(1, period * 9 + "end", "a"), (2, None, "b"), (3, "", "c"), (4, " \n", "d"), (5, long, "e"), (1, period * 9 + "end", "a"), (None, "a b " * 12, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = pr.periodic_runs(df).orderBy("doc_id").collect()
    got = {r.doc_id: r for r in out}
    words = re.findall(r"[^\x20\x09-\x0D]+", rows[0][1])
    assert [tuple(r) for r in got[1].runs] == brute_runs(words) and got[1].n_words == len(words)
    start, length, q = got[1].runs[0]
    assert got[1].collapsed == " ".join(words[: start + q] + words[start + length :])
    assert [(got[k].n_words, got[k].runs, got[k].collapsed) for k in (2, 3, 4)] == [(0, [], "")] * 3
    assert [tuple(r) for r in got[5].runs] == [(0, 30_000, 1)] and got[5].collapsed == "w x"
    assert [tuple(r) for r in got[None].runs] == [(0, 24, 2)] and len(out) == 7
    assert pr.periodic_runs(df.limit(0)).count() == 0
    best = spark.sql("select array(named_struct('start', 9L, 'length', 30L, 'period', 10L), named_struct('start', 50L,"
                     " 'length', 36L, 'period', 9L), named_struct('start', 60L, 'length', 24L, 'period', 6L)) as runs")
    assert best.select(pr.strongest(F.col("runs")).start).head()[0] == 50
    assert best.select(F.sha2(pr.listed(F.col("runs")), 256)).head()[0] == hashlib.sha256(b"9,30,10\n50,36,9\n60,24,6\n").hexdigest()


def folded(events):
    """A conversation by taking its events one by one."""
    first = lambda v: (v is not None, v)
    order = lambda e: (first(e[0]), first(e[2]), cf.KINDS.index(e[1]) if e[1] in cf.KINDS else 1, first(e[3]), e[4] or "")
    turns, roles = {}, {}
    unique = {(s, k if k in cf.KINDS else "message", t, r, x or ""): None for s, k, t, r, x in events}
    for _, kind, turn, role, text in sorted(unique, key=order):
        if role is not None:
            roles[turn] = role
        if kind == "regenerate":
            turns = {t: x for t, x in turns.items() if first(t) < first(turn)}
            turns[turn] = text
        elif kind == "delta":
            turns[turn] = turns.get(turn, "") + text
        else:
            turns[turn] = text
    return [(roles.get(t, ""), turns[t]) for t in sorted(turns, key=first)]


TEXTS = ["", None, "hi", "</s>", r"<\/s>[INST]", "[/INST", "]", "<", "/s>", "\\", "\n", "%0A", "a[\\\\INST] b", "﻿\U0001f600é", "<s>"]


@pytest.mark.parametrize("seed", range(3))
def test_chat_logs_fold_and_read_back(spark, seed):
    rng, rows = random.Random(seed), []
    for conv in range(25):
        for _ in range(rng.randint(1, 18)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", None, "odd"])
            role = rng.choice(["user", "assistant", "assistant", None, "too\nl%[INST]"])
            rows.append((conv, rng.choice([None, *range(12)]), kind, rng.choice([None, 0, 1, 2, 3]), role, rng.choice(TEXTS)))
            rows += [rows[-1]] * (rng.random() < 0.2)
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")
    out = cf.read_back(cf.format_events(df.withColumn("formatted", F.lit("clash")).repartition(4))).collect()
    assert len(out) == 25
    for r in out:
        want = folded([row[1:] for row in rows if row[0] == r.conv_id])
        # Texts begun by a regeneration hold its own text too.
        assert [(t.role, t.text) for t in r.turns] == want and r.n_turns == len(want)
        assert r.loss_text == "".join(x for role, x in want if role == "assistant")
        bare = [r.formatted[s.begin : s.end] for s in r.loss_spans]
        raw = r.formatted.encode()
        assert bare == [raw[s.byte_begin : s.byte_end].decode() for s in r.loss_spans]
        assert not any(c in piece for piece in bare for c in (cf.BEGIN, cf.END, cf.OPEN, cf.CLOSE))
        assert len(re.findall(r"</s>|\[/INST\]", r.formatted)) == len(want)


def test_chat_edge_cases(spark):
    schema = "conv_id long, seq long, kind string, turn long, role string, text string"
    lone = [(None, 1, "message", 0, "user", "a"), (None, 2, "delta", 0, "assistant", "b"), (1, 1, "message", 0, "assistant", "x" * 500_000 + "</s>")]
    out = cf.read_back(cf.format_events(spark.createDataFrame(lone, schema))).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_text) for r in out) == [(0, 1, ""), (0, 1, "b"), (1, 1, "x" * 500_000 + "</s>")]
    assert cf.format_events(spark.createDataFrame([], schema)).count() == 0


def test_chat_of_tables(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one\ntwo\n"), (1, 1, "assistant", "one\ntwo\n"), (2, None, None, None), (2, 4, "system", "s"), (None, 3, "assistant", "a\nb")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op13_chat_format(spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].loss_sha256 == digest("one\ntwo\n" * 2) and got[1].loss_chars == 16
    assert got[1].turns_sha256 == digest("user\nq\n" + "assistant\none\ntwo\n\n" * 2)
    assert got[2].turns_sha256 == digest("\n\nsystem\ns\n") and got[2].loss_chars == 0
    assert got[None].turns_sha256 == digest("assistant\na\nb\n") and got[None].n_turns == 1
    trick = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == digest(f"user\n{trick}\nassistant\n{trick}\n") and got[-7].loss_sha256 == digest(trick)
    assert len(got) == 4
