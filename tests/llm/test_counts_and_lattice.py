import random
import tracemalloc
import sys
from pathlib import Path

import numpy as np
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))

from arborinfo.llm import lattice as la
from arborinfo.llm import token_counts as tc
from arborinfo.llm.pieces import SPACE, tokenizer

PATH = tokenizer()
LETTERS = list("aaaabcdeeettth  ▁\n\té中한ﬁ漢１23=-_<>/s0xA") + ["<s>", "</s>", "<unk>", "the", " ing", "\U0001f600"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_are_the_library_s(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, n))) for n in (3, 10, 50, 900) for _ in range(150)]
    texts += ["", "a" * 3000, "ab" * 2000, "=" * 5000, " " * 3001, "▁" * 700, "aab" * 900 + "c", "0123456789" * 300]
    assert tc.count_texts(texts, PATH) == [len(x) for x in library.encode(texts)]


def test_count_columns(spark):
    rows = [(1, "the cat", 7), (2, None, 8), (3, "", 9), (3, "", 9), (None, "a " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = tc.token_counts(df, PATH).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert [tuple(r) for r in out[:4]] == [(1, 7, 2, False), (2, 0, 0, False), (3, 0, 0, False), (3, 0, 0, False)]
    assert out[4].n_bytes == 10_000 and out[4].over_limit
    assert tc.token_counts(df.limit(0), PATH).count() == 0


def all_paths(model, word):
    out = []

    def go(i, score, ids):
        if i == len(word):
            out.append((score, ids))
            return
        if word[i] not in model.score:
            go(i + 1, score + model.byte_score, ids + [model.byte_ids[b] for b in word[i].encode()])
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in model.score:
                go(j, score + model.score[word[i:j]], ids + [model.vocabulary.piece[word[i:j]]])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_is_exact():
    model, decode, rng = la.lattice(PATH), la.decoder_of(PATH), random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice(list("theing  é\n中a")) for _ in range(rng.randint(1, 9)))
        every = all_paths(model, SPACE + text.replace(" ", SPACE))
        scores, ids, _, others = la.encode_texts([text], PATH, 4)
        got = [(scores[0], ids.tolist())]
        for score, edits in others[0]:
            path = ids.tolist()
            for begin, end, new in reversed(edits):
                path[begin:end] = new
            got.append((score, path))
        assert len(got) == len(every[:4]) and len({tuple(p) for _, p in got}) == len(got)
        for (score, path), (want, _) in zip(got, every):
            assert score == pytest.approx(want, abs=1e-9) and decode(path) == text
            assert path in [p for _, p in every]


def test_paths_compare_by_their_places_from_the_end():
    rng, steps = random.Random(5), [((), la.Step(9))]
    for _ in range(400):
        places, step = rng.choice(steps[-40:] if rng.random() < 0.8 else steps)
        place = rng.randrange(9)
        if (*places, place) not in dict(steps):
            steps.append(((*places, place), la.Step(place, step, [place])))
    for _ in range(4000):
        (a, x), (b, y) = rng.choice(steps), rng.choice(steps)
        if a != b:
            assert (x < y) == (a < b)
    assert all(list(reversed(a)) == x.ids() for a, x in steps)


def test_words_of_any_length_take_little_memory():
    model, rng = la.lattice(PATH), random.Random(6)
    for word in ("".join(rng.choice("abcdefghij0123456789") for _ in range(30_000)), "a" * 30_000):
        tracemalloc.start()
        found = model.nbest(word, 3)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len({tuple(ids) for _, ids in found}) == 3 and peak < 150 << 20
        top, gap, ids = model.best([word])[0]
        assert found[0][0] == pytest.approx(top) and found[0][1] == np.frombuffer(ids, "<i4").tolist()
        assert found[0][0] - found[1][0] == pytest.approx(gap, abs=1e-6)


def test_encode_and_decode(spark):
    rows = [(1, "thé cat\n sat", "x"), (2, None, "y"), (3, "", "z"), (4, "word " * 20_000, "x"), (1, "thé cat\n sat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = la.encode(df, PATH)
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].n_tokens == got[3].n_tokens == 0 and got[3].alternatives == [] and got[3].score == 0
    assert all(r.restored for r in got.values()) and len(got[4].ids) == got[4].n_tokens
    again = la.decode(out.drop("text"), PATH).collect()
    assert {r.doc_id: r.text for r in again} == {d: t or "" for d, t, _ in rows}
    assert la.encode(df.limit(0), PATH).count() == 0
