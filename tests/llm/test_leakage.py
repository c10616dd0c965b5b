import random

import numpy as np

from lattica.llm import leakage as L
from lattica.llm.fm_index import FMIndex, WaveletMatrix, suffix_order


def test_suffix_order_against_sorting():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (50, 2), (400, 3), (900, 40)):
        s = np.append(rng.integers(0, k + 1, n), 0)
        place = {i: j for j, i in enumerate(np.flatnonzero(s == 0))}

        def key(i, s=s, place=place):
            out = []
            while s[i]:
                out.append((int(s[i]), 0))
                i += 1
            return [*out, (0, place[i])]

        assert suffix_order(s).tolist() == sorted(range(len(s)), key=key)


def test_long_repeats():
    s = np.array([1, 2] * 3000 + [0] + [1, 2] * 3000 + [0])
    order = suffix_order(s)
    assert sorted(order.tolist()) == list(range(len(s)))
    low, high = FMIndex(s, 2).search(np.array([[1, 2, 1, 2], [2, 2, 1, 1]]))
    assert (high - low).tolist() == [2 * 2999, 0]


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 30, 1000)
    m = WaveletMatrix(s, 5)
    at = rng.integers(0, 1001, 200)
    c = rng.integers(0, 30, 200)
    assert (m.follow(c, at) - m.follow(c, np.zeros(200, int))).tolist() == [int((s[:a] == x).sum()) for a, x in zip(at, c, strict=True)]
    assert m.get(np.arange(1000))[0].tolist() == s.tolist()


def test_search_and_locate_against_scanning():
    rng = np.random.default_rng(5)
    s = np.append(rng.integers(0, 6, 3000), 0)
    index = FMIndex(s, 3, sample=4)
    phrases = rng.integers(1, 6, (80, 4))
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(s) - 3) if (s[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ITEM = "Order these by weight: brisath controller, kuakilan bushing, hydraulic camera and Trosant standard 43. Explain why Repasad painted 91 heated rotors with trutad instead of tremurk, and where the rirask alloy went afterwards."


def leaks(spark, texts, items=((7, ITEM),)):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int")
    return {(r.doc_id, r.item_id) for r in L.leaks(docs, list(items)).collect()}


def test_what_is_a_leak(spark):
    random.seed(4)
    w = ITEM.split()
    shuffled = w[:]
    random.shuffle(shuffled)
    altered = [x if i % 9 else "other" for i, x in enumerate(w)]
    half = " ".join(w[: len(w) // 2 + 1])
    filler = " ".join(f"word{i}" for i in range(60))
    texts = [
        f"Before. {ITEM} After.", ITEM.upper().replace(" ", "\n "), ITEM.replace(",", "").replace("a", "ａ"), " ".join(altered), half, f"{' '.join(w[:12])}. {filler} {' '.join(w[12:26])}",
        " ".join(w[: len(w) // 4]), " ".join(shuffled), "Order these by weight: apples. Explain why we do.", "", None, filler * 500,
    ]
    assert leaks(spark, texts) == {(i, 7) for i in range(6)}


def test_scripts_without_spaces(spark):
    item = "从Kraikraisk到Glurint，信使们背着75箱baitax绕过了上部腔室。按重量排序：滤网、电极、弹性基板以及标准33。"
    assert leaks(spark, ["前言。" + item.replace("，", "\n") + "完", item[:12]], [(1, item), (2, "??"), (3, None)]) == {(0, 1)}


def test_shards_do_not_matter(spark, monkeypatch):
    texts = [f"{' '.join(f'x{i}y{j}' for j in range(50))} {ITEM if i % 5 == 0 else ''}" for i in range(60)]
    whole = leaks(spark, texts)
    monkeypatch.setattr(L, "SHARD", 100)
    assert leaks(spark, texts) == whole == {(i, 7) for i in range(0, 60, 5)}
    assert leaks(spark, [], [(1, ITEM)]) == set()


def test_spans_point_at_the_leak(spark):
    texts = [f"Ｆull\u00ad width e\u0301t. {ITEM} After. {ITEM[:110]}", f"{' '.join(ITEM.split()[:14])}. {' '.join(f'f{i}' for i in range(60))} {' '.join(ITEM.split()[14:30])} end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(tuple(r) for r in L.merged_spans(L.leaks(docs, [(7, ITEM), (8, ITEM[:150])])).collect())
    first = [r for r in rows if r[0] == 0]
    assert texts[0][first[0][1] : first[0][2]] == ITEM[:-1] and first[0][3] == 2
    assert [texts[1][a:b].split()[0] for d, a, b, _ in rows if d == 1] == ["Order", ITEM.split()[14]]
    for t in texts:
        assert [L.words(t[a:b])[0] for a, b in L.word_places(t)] == L.words(t)


def test_stock_phrases_change_no_result(monkeypatch):
    rng = random.Random(8)
    stock = ["which of the following is true", "in the year of the report", "given the table above answer"]
    items = [(i, " ".join(rng.choice([*stock, *(f"w{rng.randint(0, 300)}" for _ in range(4))]) for _ in range(rng.randint(3, 9)))) for i in range(120)]
    docs = [" ".join([*(f"w{rng.randint(0, 300)}" for _ in range(30)), rng.choice(items)[1], *rng.choices(stock, k=6), f"w{rng.randint(0, 300)}"]) for _ in range(60)]

    def pairs():
        phrases = L.Phrases(items)
        shard = L.Shard(phrases)
        for d in docs:
            shard.add(phrases.code(d))
        return {(d, i, round(s, 9)) for d, i, s, _ in shard.found(0.5)}

    with_stock = pairs()
    monkeypatch.setattr(L, "STOCK", 10**9)
    monkeypatch.setattr(L, "SEARCHED", 7)
    assert with_stock == pairs() and len(with_stock) >= 60
