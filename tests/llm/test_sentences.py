import random
import time

import pytest

from lattica.llm import sentences as S

OPENERS = ["The device", "A rotor", "In this case the unit", "Preferably, the beam", "Each layer", "However, the film"]
ABBR = ["as shown in Fig. {n}, the rotor turns", "known from No. {n} of the list", "made by Smith et al. in an earlier text", "i.e. it is thin", "e.g. by laser, and then cooled", "of min. {n} mm and max. {n} mm"]


def corpus(n, seed=1):
    random.seed(seed)
    texts, ends = [], []
    for _ in range(n):
        text, cut = "Title of the thing\n\n", [len("Title of the thing")]
        for _ in range(3):
            for k in range(6):
                s = f"{random.choice(OPENERS)} is {random.choice(ABBR).format(n=random.randint(2, 99))}{random.choice(['.', '.', '?', '!'])}"
                text += s
                cut.append(len(text))
                text += " " if k < 5 else "\n\n"
        texts.append(text)
        ends.append(cut)
    return texts, ends


@pytest.fixture(scope="module")
def model():
    return S.train(corpus(150)[0])


def test_held_out_accuracy(model):
    texts, ends = corpus(60, 9)
    right = found = there = 0
    for t, e in zip(texts, ends, strict=True):
        got = set(S.split(t, model)[1])
        right, found, there = right + len(got & set(e)), found + len(got), there + len(e)
    assert right / found > 0.99 and right / there > 0.99


def cut(text, model):
    return [text[a:b] for a, b in zip(*S.split(text, model), strict=True)]


def test_layout(model):
    text = "A pump\n\nABSTRACT\nThe pump is\nthin.\n[0001] The torque follows from\n    y=a.x^2+b\nwherein it is at rest. A rotor is new.\nWhat is claimed is:\n\n1. A pump, comprising:\n    a) a rotor; and\n    b) a film.\n2. The pump of claim 1\n3. The pump of claim 2, cut"
    assert cut(text, model) == ["A pump", "ABSTRACT", "The pump is\nthin.", "[0001] The torque follows from\n    y=a.x^2+b\nwherein it is at rest.", "A rotor is new.", "What is claimed is:", "1. A pump, comprising:\n    a) a rotor; and\n    b) a film.", "2. The pump of claim 1", "3. The pump of claim 2, cut"]


def test_text_in_capitals_is_no_heading(model):
    text = "The unit is new.\nTHE DEVICE IS MADE BY HAND AND\nTHEN COOLED FOR A LONG TIME.\nDETAILED DESCRIPTION\nThe unit is old."
    assert cut(text, model) == ["The unit is new.", "THE DEVICE IS MADE BY HAND AND\nTHEN COOLED FOR A LONG TIME.", "DETAILED DESCRIPTION", "The unit is old."]


def test_scripts(model):
    assert cut("结果令人惊讶！“停！内有”字样出现。厚度为8.12毫米，小于薄膜．泵体保持不动。", model) == ["结果令人惊讶！", "“停！内有”字样出现。", "厚度为8.12毫米，小于薄膜．", "泵体保持不动。"]
    assert cut("กระจกดี เพลาหมายเลข 54 หมุน\nปั๊มใหม่", model) == ["กระจกดี", "เพลาหมายเลข 54 หมุน", "ปั๊มใหม่"]
    assert cut("दाब बढ़ता है। क्या पंप है? हाँ।", model) == ["दाब बढ़ता है।", "क्या पंप है?", "हाँ।"]


def test_points_that_end_nothing(model):
    assert cut("The law is U = R . I, where it is at rest. The device is new.", model) == ["The law is U = R . I, where it is at rest.", "The device is new."]
    assert cut("可以采用nifuapid.所述壳体的厚度约为9.55毫米.", model) == ["可以采用nifuapid.", "所述壳体的厚度约为9.55毫米."]


def test_edges(model):
    assert S.split("", model) == S.split(None, model) == S.split(" \n ", model) == ([], [])
    assert cut("  x ", model) == ["x"] and cut("No stop here", model) == ["No stop here"] and cut(".", model) == ["."]
    long = "The unit is new. " * 20_000
    assert len(cut(long, model)) == 20_000


def test_all_text_is_covered(model):
    random.seed(6)
    for _ in range(300):
        text = "".join(random.choices('ab A1 .!?…。"“”„()«»\n\n  |มन。،[0]', k=random.randint(0, 60)))
        at = 0
        for a, b in zip(*S.split(text, model), strict=True):
            assert not text[at:a].strip() and a < b and text[a:b] == text[a:b].strip()
            at = b
        assert not text[at:].strip()


def test_chain_posteriors_sum_over_all_paths():
    m, odds = S.Model(), [1.2, -0.4, 2.0, 0.3]
    out = [0.0] * 4
    m._chain(odds, 0, 4, out)
    import itertools
    import math

    total, one = 0.0, [0.0] * 4
    for path in itertools.product((0, 1), repeat=4):
        w = math.exp(sum(o for o, e in zip(odds, path, strict=True) if e) - S.NEAR * sum(a and b for a, b in zip(path, path[1:], strict=False)))
        total += w
        for i, e in enumerate(path):
            one[i] += w * e
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(out, one, strict=True))


def test_on_a_table(spark, model):
    docs = spark.createDataFrame([(1, "The unit is new. A rotor is old.", 0), (2, None, 0), (3, "", 0), (1, "The unit is new. A rotor is old.", 0)], "doc_id bigint, text string, start_pos int")
    assert sorted(tuple(r) for r in S.sentences(docs, model).collect()) == [(1, 0, 16), (1, 0, 16), (1, 17, 32), (1, 17, 32)]
    assert S.sentences(docs.limit(0), S.train([])).count() == 0


def test_counts_are_those_of_all_documents_whole(spark, tmp_path):
    texts = corpus(40)[0] + ["The zorb. A rotor. " * 1_500, "结果令人惊讶！“停！内有”字样出现。(see note) no. 5A.The film" * 3, "", " \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scan = S.scanned(docs)
    counts = S.corpus_counts(scan)
    assert counts.hidden[(".zorb", "A")] == 1_500 and ".zorb" in S.fit(counts).left
    whole, here = S.train(texts), S.fit(counts)
    assert here.left == pytest.approx(whole.left) and here.right == pytest.approx(whole.right) and here.right_class == pytest.approx(whole.right_class)
    want = sorted((d, a, b) for d, t in enumerate(texts) for a, b in zip(*S.split(t, whole), strict=True))
    assert sorted(tuple(r) for r in S.p8_found(spark, str(tmp_path)).collect()) == want
    assert S.scanned_sentences(S.scanned(docs.limit(0)), here).count() == 0 and S.corpus_counts(S.scanned(docs.limit(0))) == ({},) * 5


def test_long_quotations_and_brackets(model):
    inner = "The unit is new. " * 40
    for a, z in ('""', "“”", "„“", "«»", "()"):
        first, second = f"The text {a}{inner.strip()}{z} is old.", f"The word {a}unit{z} is old."
        assert cut(f"{first} The film is thin. {second}", model) == [first, "The film is thin.", second]
    assert cut('A 5" pipe is new. The film (see (a) and "b. The". The rotor is old.\n\nA film) is thin.', model) == ['A 5" pipe is new.', 'The film (see (a) and "b. The".', "The rotor is old.", "A film) is thin."]
    assert len(cut("(" * 100_000 + "The unit is new. " * 10 + ")" * 100_000, model)) == 1


def test_time_grows_as_the_length_of_a_line():
    def seconds(n):
        text = "The unit no. 5 is new. " * n
        began = time.thread_time()
        assert len(S.gaps(text)) == 2 * n
        return time.thread_time() - began

    assert min(seconds(80_000) for _ in range(2)) < 3 * 8 * min(seconds(10_000) for _ in range(3))


def test_words_are_counted_whole_in_any_script():
    def words(text):
        counts = S.Counts(*[S.Counter() for _ in range(5)])
        here = S.gaps(text)
        S._tally(text, here, counts)
        starts = {g.next for g in here}
        return S._keyed(counts), S.Counter(S._key(m.group(1)) for m in S._RUNNING.finditer(text) if m.start() not in starts)

    for text in ("The unit (a rotor) is no. 5A.The film-like unit is new.\n\nThe end.", "可以采用nifuapid.所述壳体的厚度约为9.55毫米.结果令人惊讶！“停！内有”字样出现。" * 3, "5. 5. “x”.y。的z.所述 9-x 9-x。A", ".", "。的"):
        got, want = words(text)
        assert got == want and 0 not in got.values()
