import random

import numpy as np

from lattica.llm import packing as P


def unpack(plan):
    return [dict(items) for times, items in plan for _ in range(times)]


def test_every_item_once_and_no_container_too_full():
    random.seed(2)
    for n in (0, 1, 7, 400, 5000):
        counts = np.zeros(101, np.int64)
        for _ in range(n):
            counts[random.choice([random.randint(1, 100), 50, 34, 100])] += 1
        bins = unpack(P.best_two_fit(counts, 100))
        assert all(sum(s * k for s, k in b.items()) <= 100 for b in bins)
        assert [sum(b.get(s, 0) for b in bins) for s in range(1, 101)] == counts[1:].tolist()


def test_two_that_fit_better_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    # 6 + 3 leaves one unit; instead of 3, two of 2 fill the container.
    assert P.best_two_fit(counts, 10)[0] == (1, {6: 1, 2: 2})


def test_close_to_the_least_number():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(5.5, 1, 20_000).astype(int) + 1, 2048)
    counts = np.bincount(sizes, minlength=2049)
    assert len(unpack(P.best_two_fit(counts, 2048))) <= 1.002 * sizes.sum() / 2048 + 1


def test_repetition_equals_one_by_one():
    counts = np.zeros(21, np.int64)
    counts[[11, 9, 7, 4]] = [40, 30, 25, 60]
    one = counts.copy()
    alone = []
    while one.sum():
        items = P.best_two_fit(one, 20)[0][1]
        alone.append(items)
        for s, k in items.items():
            one[s] -= k
    assert sorted(map(sorted, (b.items() for b in alone))) == sorted(map(sorted, (b.items() for b in unpack(P.best_two_fit(counts, 20)))))


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_RANK_TASK", 100)
    rows = [(i, 5 if i % 3 else i % 23) for i in range(1000)] + [(5000, 7001), (None, 3), (None, 3), (1, 5)]
    got = P.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), 64).toPandas()
    filled = got[got.container_id.notna()]
    assert filled.groupby("container_id").n_tokens.sum().max() <= 64
    assert set(filled.container_id.astype(int)) == set(range(int(filled.container_id.max()) + 1))
    assert len(filled[filled.doc_id == 5000]) == 110 and filled[filled.doc_id == 5000].n_tokens.sum() == 7001
    assert got.groupby("doc_id").n_tokens.sum().drop(5000).to_dict() == {i: (5 if i % 3 else i % 23) for i in range(1000)}
    assert got.doc_id.isna().sum() == 2 and (got[got.n_tokens == 0].container_id.isna()).all()
    assert P.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "a claim, a device", 0), (2, "", 0), (3, None, 0), (4, "<|endoftext|> ü" * 2000, 0)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in P.token_counts(docs).collect()}
    own = P.tokenizer(f"{P.TOKENIZER_FOLDER}/{P.TOKENIZER}")
    assert got == {1: len(own.encode_ordinary("a claim, a device")), 2: 0, 3: 0, 4: len(own.encode_ordinary("<|endoftext|> ü" * 2000))}
