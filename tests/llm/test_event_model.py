import itertools
import random

import numpy as np

from lattica.llm import event_model as E


def model(rng, size=12):
    pair = np.unique((rng.integers(0, size, 60) << 20) | rng.integers(0, size, 60))
    n = rng.integers(3, 30, len(pair)).astype(float)
    words = rng.integers(20, 90, size).astype(float)
    return E.Model(pair, n, n * rng.random(len(pair)), n * rng.random(len(pair)), words, words * rng.random(size), rng.random(2 * size) * 9, rng.random(size), rng.random(size), rng.random(size), n, words, rng.random(size))


def triples(texts):
    v = np.array([x for t in texts for x in (0, *t)])
    return np.append(0, v[:-1]), v, np.append(v[1:], 0)


def test_posteriors_like_all_paths():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        m = model(rng)
        u, v, w = triples([rng.integers(4, 12, n).tolist()])
        s0, s1, first, word = m.factors(u, v, w, m.tables())
        never, sure = E._known(v, w)
        total, yes = 0.0, np.zeros(len(v))
        for path in itertools.product((0, 1), repeat=len(v)):
            p, before = 1.0, 0
            for i, e in enumerate(path):
                s = s1[i] if before else s0[i]
                p *= (0.0 if never[i] else s * first[i]) if e else (0.0 if sure[i] else (1 - s) * word[i])
                before = e
            total += p
            yes += p * np.array(path)
        for width in (2, 64):
            assert np.allclose(E.posteriors(m, u, v, w, width=width), yes / total)


def test_texts_follow_one_another():
    rng = np.random.default_rng(4)
    m = model(rng)
    texts = [rng.integers(4, 12, k).tolist() for k in (3, 40, 1, 200)]
    alone = np.concatenate([E.posteriors(m, *triples([t])) for t in texts])
    assert np.allclose(alone, E.posteriors(m, *triples(texts), width=16))


def corpus(rng, n):
    starts, middles = ["The", "A", "However", "In"], ["pump", "valve", "moves", "of", "steel", "with", "the", "shaft", "Dr. Lee"]
    out = []
    for i in range(n):
        sentences = [" ".join([rng.choice(starts), *rng.choices(middles, k=rng.randint(4, 9))]) + "." for _ in range(6)]
        text = "\n\n".join([" ".join(sentences[:1]), " ".join(sentences[1:3]), " ".join(sentences[3:])])
        out.append((i, text, [x for x in sentences]))
    return out


def test_planted_boundaries(spark):
    rng = random.Random(5)
    rows = corpus(rng, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(-1, None), (-2, ""), (-3, " \n"), (-4, "Alone")], "doc_id bigint, text string")
    got = {}
    for r in E.hidden_event_sentences(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    assert {-1, -2, -3}.isdisjoint(got) and got[-4] == [(0, 5)]
    good = sum(len({t[a:b] for a, b in got[i]} & set(s)) for i, t, s in rows)
    assert good >= 0.97 * 6 * len(rows)
    for i, t, _ in rows:
        spans = sorted(got[i])
        assert all(a < b and t[a:b].strip() == t[a:b] for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert not "".join(t[x[1] : y[0]] for x, y in zip(spans, spans[1:], strict=False)).strip()


def test_boundaries_without_stops(spark):
    rng = random.Random(6)
    rows = corpus(rng, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    words, total = E.vocabulary(docs)
    m = E.train(docs, words, total)
    text = "However pump of steel moves with the valve The shaft of steel moves the valve"
    _, start, end = E.split([text], words, m)
    assert [text[a:b] for a, b in zip(start, end, strict=True)] == ["However pump of steel moves with the valve", "The shaft of steel moves the valve"]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert E.hidden_event_sentences(docs).count() == 0
