"""Sentence boundaries by a hidden-event n-gram language model alone, without rules of layout.

A text is a sequence of words, signs and line breaks; ideographs, kana and Thai letters are words of their own, so scripts
without spaces or stops are treated like all others. Between any two of them a boundary token <s> may be hidden. The model
is an n-gram model of the sequence with these tokens: an event follows its last two words with P(<s> | u, v), a word the
word before with P(w | v), or the boundary with P(w | <s>). The posteriors of all events of a text come from the
forward-backward algorithm over the whole text, whose two states say whether an event came just before.

Training is unlabelled: only the ends of paragraphs and texts are known, all other events are hidden and found by expectation
maximisation over the counts of all word triples of all documents. Counting and the expectations run on the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.sentences import _shape, p8_found
from lattica.sources.tables import load, materialize

_ALONE = "฀-๿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿"
_THAI = "฀-๿"
#: Words and signs: blank lines, line breaks, spaces between Thai letters, numbers, letters of scripts without spaces, words, others.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ɏЀ-ӿ"
_TOKEN = re.compile(
    rf"[{_LETTERS}]+(?:['’][{_LETTERS}]+)*|\d+(?:[.,]\d+)*|\n(?:[^\S\n]*\n\s*)?|[!-/:-@\[-`{{-~]|[{_ALONE}]|[ऀ-ॣॱ-ॿ\u200c\u200d]+|[^\W\d_{_ALONE}ऀ-ॿ{_LETTERS}]+|(?<=[{_THAI}])[^\S\n]+(?=[{_THAI}])|\S"
)
#: The same with all other white space, so that the tokens tile the text.
_TILED = re.compile(rf" (?![{_THAI}\s])|{_TOKEN.pattern}|[^\S\n]+")
#: Share of all words that a word, and a pair of words, must have to count on its own; at least ``LEAST_COUNT`` times.
WORD_SHARE, PAIR_SHARE, LEAST_COUNT = 2.0**-19, 2.0**-22, 3
EM_ROUNDS = 4
#: Weight of the shorter n-gram that a longer one falls back to.
BACK_OFF = 4.0
#: Signs that end sentences, and those of them that do little else. Fixed values.
_STOPS, _PURE = ".．|", "!?。！？｡।॥"
#: By what a word is: how probable a boundary is behind it before any count, and the weight of that against a count.
PRIOR = {"stop": (0.5, 0.0), "pure": (0.95, 1.0), "line": (0.3, 0.0), "space": (0.99, 10.0), "other": (1e-3, 10.0)}
_BITS = 20
#: Words coded at a time.
CHUNK = 1_000_000
_EDGE = "<edge>"


def _kind(token: str) -> str:
    """What stands for a token: numbers by their form, white space by its kind."""
    if token[0].isspace():
        return "<par>" if token.count("\n") > 1 else "<line>" if token[0] == "\n" else "<space>"
    return re.sub(r"\d+", "9", token) if token[0].isdigit() else token


class Vocabulary:
    """Numbers of tokens; a token that isn't listed has the number of its class."""

    def __init__(self, words: list[str]) -> None:
        self.words = [_EDGE, "<par>", "<line>", "<space>", *words]
        self.of = {w: i for i, w in enumerate(self.words)}
        #: Words that may be Thai letters: those, and classes.
        self.thai = np.array(["\u0e00" <= w[0] <= "\u0e7f" or w[0] == "<" and len(w) > 1 for w in self.words])

    def code(self, tokens: list[str], known: dict[str, int]) -> list[int]:
        """Numbers of ``tokens``; ``known`` remembers those met before."""
        out = list(map(known.get, tokens))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    t = tokens[i]
                    k = self.of.get(_kind(t))
                    out[i] = known[t] = self.of.get(_shape(t), self.of.get("<?>", 0)) if k is None else k
            if len(known) > 500_000:
                known.clear()
        return out


class Model(NamedTuple):
    """Expected counts: of pairs (packed, ascending), of words, of boundaries after and before them."""

    pair: np.ndarray
    pair_n: np.ndarray
    #: Events behind the second word of a pair, and between its words.
    pair_after: np.ndarray
    pair_between: np.ndarray
    word_n: np.ndarray
    word_after: np.ndarray
    #: A boundary with white space and one without are two tokens, each with its own words behind it: word, or word + size.
    word_first: np.ndarray
    #: Words that are a sentence of their own.
    word_lone: np.ndarray
    #: Probability of an event behind a word before any count, and its weight in counts of the word.
    guess: np.ndarray
    trust: np.ndarray
    #: Pairs and words behind which an event is possible: no white space follows, as a boundary stands behind white space.
    pair_open: np.ndarray
    word_open: np.ndarray
    #: Occurrences of a word in pairs too rare to be kept.
    word_rare: np.ndarray

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a << _BITS) | b
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        return at, (self.pair[at] == key) if len(self.pair) else np.zeros(len(key), bool)

    def tables(self) -> tuple[np.ndarray, ...]:
        """By word: P(<s> | v) and P(<s> | <s>, v), P(w | <s>) with and without white space, P(w), how often v runs on, and its loose weight."""
        k, n, size = BACK_OFF, max(self.word_n.sum(), 1.0), len(self.word_n)
        plain = (self.word_n + 0.5) / (n + 0.5 * size)
        held = k + self.trust * self.word_open
        after = (self.word_after + held * self.guess) / (self.word_open + held)
        began = self.word_first[:size] + self.word_first[size:]
        lone = np.clip((self.word_lone + k * 0.1 * after) / (began + k), 1e-9, 1 - 1e-9)
        sums = self.word_first.reshape(2, size).sum(axis=1, keepdims=True)
        first = ((self.word_first.reshape(2, size) + 10 * k * plain) / (sums + 10 * k)).ravel()
        within = np.maximum(self.word_n - self.word_after, 0.0)
        # Behind a sign or break the sentence runs on with any word, so what was counted there weighs only half.
        loose = k + self.word_rare + np.where(self.guess > PRIOR["other"][0], within, 0.0)
        return after, lone, first, plain, within, loose

    def factors(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, tables: tuple[np.ndarray, ...], chained: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """P(<s> | u, v), P(<s> | <s>, v), P(w | <s>) and P(w | v) for triples of words; ``chained`` ones follow one another."""
        after, lone, first, plain, within, loose = tables
        size = len(self.word_n)
        if len(self.pair):
            at_vw, there_vw = self._pairs(v, w)
            at_uv, there_uv = self._pairs(u[:1] if chained else u, v[:1] if chained else v)
            if chained:
                at_uv, there_uv = np.append(at_uv, at_vw[:-1]), np.append(there_uv, there_vw[:-1])
            open_ = np.where(there_uv, self.pair_open[at_uv], 0.0)
            ended = np.where(there_uv, self.pair_after[at_uv], 0.0)
            seen = np.where(there_vw, np.maximum(self.pair_n[at_vw] - self.pair_between[at_vw], 0.0), 0.0)
        else:
            open_ = ended = seen = np.zeros(len(v))
        held = BACK_OFF + self.trust[v] * open_
        s0 = np.clip((ended + held * after[v]) / (open_ + held), 1e-9, 1 - 1e-9)
        word = (seen + loose[v] * plain[w]) / (within[v] + loose[v])
        return s0, lone[v], first[w + size * (v > 3)], word


#: Events that are known: none before white space or within the edge, one behind a blank line and at a text's end.
def _known(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    never = (w >= 1) & (w <= 3) | (v == 0)
    return never, ((v == 1) | (w == 0)) & ~never


def expected(model: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """Probability of an event between v and w, the one before being none."""
    s0, _, first, word = model.factors(u, v, w, tables)
    p = s0 * first / (s0 * first + (1 - s0) * word)
    never, sure = _known(v, w)
    return np.where(never, 0.0, np.where(sure, 1.0, p))


def posteriors(model: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray, tables: tuple[np.ndarray, ...] | None = None, width: int = 64) -> np.ndarray:
    """Posterior of the event between v and w for all gaps of whole texts in order, by forward-backward.

    A gap is a matrix from the event before to its own. The chain is cut into stretches whose matrices are multiplied in
    step; products carry the state from stretch to stretch, and a second pass gives every gap. It is exact for any length.
    """
    n = len(v)
    if not n:
        return np.zeros(0)
    s0, s1, first, word = model.factors(u, v, w, tables or model.tables(), chained=True)
    never, sure = _known(v, w)
    rows = -(-n // width)

    def laid(x: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(rows * width, fill)
        out[:n] = x
        return np.ascontiguousarray(out.reshape(rows, width).T)

    none = np.where(sure, 0.0, word)
    one = np.where(never, 0.0, first)
    m = [laid((1 - s0) * none, 1.0), laid(s0 * one, 0.0), laid((1 - s1) * none, 0.0), laid(s1 * one, 1.0)]
    peak = np.maximum(np.maximum(m[0], m[1]), np.maximum(m[2], m[3]))
    m = [x / peak for x in m]
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(width):
        p, q, r, s = (x[t] for x in m)
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    into, back = np.empty((rows, 2)), np.empty((rows, 2))
    x, y = 1.0, 0.0
    for i, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        into[i] = x, y
        x, y = x * p + y * r, x * q + y * s
        top = x + y
        x, y = x / top, y / top
    x, y = 1.0, 1.0
    for i, (p, q, r, s) in reversed(list(enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)))):
        back[i] = x, y
        x, y = p * x + q * y, r * x + s * y
        top = x + y
        x, y = x / top, y / top
    f0, f1 = np.empty((width, rows)), np.empty((width, rows))
    x, y = into[:, 0], into[:, 1]
    for t in range(width):
        x, y = x * m[0][t] + y * m[2][t], x * m[1][t] + y * m[3][t]
        top = x + y
        x, y = x / top, y / top
        f0[t], f1[t] = x, y
    out = np.empty((width, rows))
    x, y = back[:, 0], back[:, 1]
    for t in range(width - 1, -1, -1):
        none_, one_ = f0[t] * x, f1[t] * y
        out[t] = one_ / (none_ + one_)
        x, y = m[0][t] * x + m[1][t] * y, m[2][t] * x + m[3][t] * y
        top = x + y
        x, y = x / top, y / top
    return out.T.ravel()[:n]


def _texts(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[pa.Array, list[str]]]:
    """Texts of (doc_id, text) that have any, with their ids, some ``size`` characters at a time."""
    for batch in batches:
        ids, texts, held, low = batch.column(0), batch.column(1).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= size or i + 1 == len(texts):
                part = [k for k in range(low, i + 1) if texts[k] and not texts[k].isspace()]
                if part:
                    yield ids.take(pa.array(part)), [texts[k] for k in part]
                held, low = 0, i + 1


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The words that all documents have often enough, with their counts; the others count for their class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            keyed: Counter[str] = Counter()
            for t, n in found.items():
                keyed[_kind(t)] += n
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(keyed, pa.string()), pa.array(keyed.values(), pa.int64())], ["word", "n"])

        for _, texts in _texts(batches):
            for t in texts:
                found.update(_TOKEN.findall(t))
            if len(found) > 300_000:
                yield passed()
        if found:
            yield passed()

    counted = materialize(docs.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, int(total * WORD_SHARE))
    often = {r.word: r.n for r in counted.filter(F.col("n") >= least).collect() if not r.word.startswith("<") or len(r.word) == 1}

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[_shape(word) if word else "<?>"] += n
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    rare = {r.word: r.n for r in counted.filter(F.col("n") < least).mapInArrow(classes, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return Vocabulary([*sorted(often), *sorted({*rare, "<?>"} - {*often})]), total


_TRIPLE = "uv bigint, w bigint, n bigint"


def triple_counts(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(uv, w, n): how often each triple of words stands in all documents, edges included; uv holds two words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def passed() -> pa.RecordBatch:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            own, inverse = np.unique(key, return_inverse=True)
            total = np.bincount(inverse, weights=n).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own >> _BITS), pa.array(own & ((1 << _BITS) - 1)), pa.array(total)], ["uv", "w", "n"])

        for _, texts in _texts(batches):
            flat: list[int] = []
            for t in texts:
                flat.append(0)
                flat += words.code(_TOKEN.findall(t), known)
            v = np.array(flat, np.int64)
            key = (np.append(0, v[:-1]) << 2 * _BITS) | (v << _BITS) | np.append(v[1:], 0)
            held.append(np.unique(key, return_counts=True))
            if sum(len(k) for k, _ in held) > 4 * CHUNK:
                yield passed()
        if held:
            yield passed()

    return docs.mapInArrow(count, _TRIPLE).groupBy("uv", "w").agg(F.sum("n").alias("n"))


_AFTER, _BETWEEN, _WORD_AFTER, _WORD_FIRST, _WORD_LONE = range(5)


def train(docs: DataFrame, words: Vocabulary, total: int, rounds: int = EM_ROUNDS) -> Model:
    """The model of all documents (doc_id, text), of ``total`` words."""
    size = len(words.words)
    triples = materialize(triple_counts(docs, words))
    least = max(LEAST_COUNT, int(total * PAIR_SHARE))
    pairs = triples.groupBy("uv").agg(F.sum("n").alias("n"))
    kept = pairs.filter(F.col("n") >= least).toArrow().sort_by("uv")
    single = pairs.groupBy((F.col("uv") % (1 << _BITS)).alias("v")).agg(F.sum("n").alias("n")).toArrow()
    word_n = np.zeros(size)
    word_n[np.array(single["v"])] = np.array(single["n"])
    pair, pair_n = np.array(kept["uv"]), np.array(kept["n"]).astype(float)
    open_ = triples.filter("w = 0 or w > 3").groupBy("uv").agg(F.sum("n").alias("n"))
    pair_open, word_open = np.zeros(len(pair)), np.zeros(size)
    rows = open_.filter(F.col("n") > 0).join(pairs.filter(F.col("n") >= least).select("uv"), "uv", "left_semi").toArrow()
    pair_open[np.searchsorted(pair, np.array(rows["uv"]))] = np.array(rows["n"])
    rows = open_.groupBy((F.col("uv") % (1 << _BITS)).alias("v")).agg(F.sum("n").alias("n")).toArrow()
    word_open[np.array(rows["v"])] = np.array(rows["n"])
    rare = np.maximum(word_n - np.bincount(pair >> _BITS, weights=pair_n, minlength=size), 0.0)
    kind = np.full(size, "other")
    for name, signs in (("stop", _STOPS), ("pure", _PURE)):
        kind[[words.of[x] for x in signs if x in words.of]] = name
    kind[1:4] = "pure", "line", "space"
    guess, trust = (np.array([PRIOR[k][i] for k in kind.tolist()]) for i in (0, 1))
    # Before any count a word begins a sentence as often as a paragraph, and runs on as often as behind words that are no signs.
    last = F.col("uv") % (1 << _BITS)
    signs = {k: np.flatnonzero(kind == k).tolist() for k in ("stop", "pure", "space")}
    place = F.when(last.isin(0, 1), 0).when(last == 2, 1).when(last.isin(signs["space"]), 2).when(last.isin(signs["pure"]), 3).when(last.isin(signs["stop"]), 4).otherwise(5).alias("place")
    begin, running = np.zeros(2 * size), np.zeros(size)
    rows = triples.filter("w = 0 or w > 3").groupBy("w", place).agg(F.sum("n").alias("n")).toArrow()
    w, at, n = (np.array(rows[c]) for c in ("w", "place", "n"))
    for k, weight, shift in ((0, 1.0, 0), (1, 0.1, 0), (2, PRIOR["space"][0], 0), (0, 1.0, size), (3, PRIOR["pure"][0], size)):
        begin[w[at == k] + shift] += n[at == k] * weight
    # Numbers, brackets and other signs open paragraphs rather than sentences within them.
    sign = np.array([not x[0].isalpha() and x[0] != "<" for x in words.words])
    begin[size:][sign] *= 0.05
    running[w[at == 5]] = n[at == 5]
    share = (running + 0.5) / (running.sum() + 0.5 * size)
    u, v = pair >> _BITS, pair & ((1 << _BITS) - 1)
    start = ((begin.reshape(2, size) + 0.5) / (begin.reshape(2, size).sum(axis=1, keepdims=True) + 0.5 * size)).ravel()[v + size * (u > 3)]
    between = guess[u] * start / (guess[u] * start + (1 - guess[u]) * share[v]) * pair_n
    model = Model(pair, pair_n, guess[v] * pair_open, between, word_n, guess * word_open, begin, np.zeros(size), guess, trust, pair_open, word_open, rare)
    for _ in range(rounds):
        model = _round(triples, model)
    return model


def _round(triples: DataFrame, model: Model) -> Model:
    """One round of expectation maximisation: expected events of all triples, summed by pair and word."""
    share = np.where(model.pair_n > 0, model.pair_between / np.maximum(model.pair_n, 1), 0.0)
    tables = model.tables()

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << _BITS) - 1
        held: list[pa.RecordBatch] = []

        def passed() -> pa.RecordBatch:
            uv, w, n = (np.concatenate([np.array(b.column(k)) for b in held]) for k in range(3))
            held.clear()
            u, v = uv >> _BITS, uv & mask
            p = expected(model, u, v, w, tables) * n
            at, there = model._pairs(u, v)
            # What begins sentences is learned behind signs and breaks, or any rare word would come to.
            plainly = model.guess[v] > PRIOR["other"][0]
            lone = p * np.where(there, share[at] if len(share) else 0.0, 0.0)
            sums = [(_AFTER, uv[there], p[there]), (_BETWEEN, (v << _BITS) | w, p), (_WORD_AFTER, v, p), (_WORD_FIRST, (w + len(model.word_n) * (v > 3))[plainly], p[plainly]), (_WORD_LONE, v, lone)]
            rows = []
            for kind, key, x in sums:
                if kind == _BETWEEN:
                    there2 = model._pairs(v, w)[1]
                    key, x = key[there2], x[there2]
                own, inverse = np.unique(key, return_inverse=True)
                total = np.bincount(inverse, weights=x, minlength=len(own))
                own, total = own[total > 1e-6], total[total > 1e-6]
                rows.append((np.full(len(own), kind, np.int32), own, total))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in range(3)], ["kind", "key", "p"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield passed()
                rows = 0
        if held:
            yield passed()

    sums = triples.mapInArrow(expect, "kind int, key bigint, p double").groupBy("kind", "key").agg(F.sum("p").alias("p")).toArrow()
    kind, key, p = (np.array(sums[c]) for c in ("kind", "key", "p"))
    out = {k: np.zeros(len(model.pair) if k in (_AFTER, _BETWEEN) else len(model.word_n) * (1 + (k == _WORD_FIRST))) for k in range(5)}
    for k in range(5):
        own = kind == k
        out[k][np.searchsorted(model.pair, key[own]) if k in (_AFTER, _BETWEEN) else key[own]] = p[own]
    return model._replace(pair_after=out[_AFTER], pair_between=out[_BETWEEN], word_after=out[_WORD_AFTER], word_first=out[_WORD_FIRST], word_lone=out[_WORD_LONE])


def tokens(texts: list[str], words: Vocabulary, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, text, start and end of each token of some texts, in order."""
    # White space outside Thai is no token, but tiles the text: tokens lie where the lengths of all before them say.
    flat: list[str] = []
    size = []
    for t in texts:
        found = _TILED.findall(t)
        size.append(len(found))
        flat += found
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    code = np.array(words.code(flat, known), np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    begun = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    end = np.cumsum(length) - begun[doc]
    space = np.flatnonzero(code == 3)
    kept = np.ones(len(code), bool)
    if len(space):
        # Only a blank between two Thai letters is a token; the classes of rare words are looked at one by one.
        before, behind = np.maximum(space - 1, 0), np.minimum(space + 1, len(flat) - 1)
        between = words.thai[code[before]] & words.thai[code[behind]] & (doc[before] == doc[space]) & (doc[behind] == doc[space])
        for i in np.flatnonzero(between).tolist():
            between[i] = all("\u0e00" <= flat[x][:1] <= "\u0e7f" for x in (before[i], behind[i]))
        kept[space[~between]] = False
    return code[kept], doc[kept], (end - length)[kept], end[kept]


def marked(code: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, texts: int, model: Model, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, start, end) of the sentences of the ``tokens`` of some texts."""
    # Each text begins with an edge.
    head = np.searchsorted(doc, np.arange(texts))
    v = np.insert(code, head, 0)
    ends = posteriors(model, np.append(0, v[:-1]), v, np.append(v[1:], 0), tables) > 0.5
    events = np.delete(ends, head + np.arange(texts))
    # A sentence runs from the first to the last token that shows between two events.
    sentence = np.append(0, np.cumsum(events)[:-1]) if len(events) else events
    shown = np.flatnonzero(code > 3)
    if not len(shown):
        return doc[:0], start[:0], end[:0]
    first = np.append(True, (sentence[shown][1:] != sentence[shown][:-1]) | (doc[shown][1:] != doc[shown][:-1]))
    lasts = shown[np.append(np.flatnonzero(first)[1:] - 1, len(shown) - 1)]
    return doc[shown[first]], start[shown[first]], end[lasts]


def split(texts: list[str], words: Vocabulary, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, start, end) of the sentences of some texts, in code points, without surrounding white space."""
    return marked(*tokens(texts, words, {}), len(texts), model, model.tables())


def sentences(docs: DataFrame, words: Vocabulary, model: Model) -> DataFrame:
    """(doc_id, start_pos, end_pos) of the sentences of documents (doc_id, text). An empty or null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        tables = model.tables()
        for ids, texts in _texts(batches):
            doc, start, end = marked(*tokens(texts, words, known), len(texts), model, tables)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "start_pos", "end_pos"])

    return docs.mapInArrow(run, "doc_id bigint, start_pos int, end_pos int")


def hidden_event_sentences(docs: DataFrame) -> DataFrame:
    """Sentences of documents (doc_id, text) by a model trained on all of them."""
    words, total = vocabulary(docs)
    return sentences(docs, words, train(docs, words, total))


def p8_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return hidden_event_sentences(docs)


def p8_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of p8_found, of p8_method, and those of both, by the script that the document's text shows first of those listed."""
    text = F.col("text")
    scripts = {"thai": f"[{_THAI}]", "kana": "[぀-ヿ]", "ideographs": "[一-鿿]", "devanagari": "[ऀ-ॿ]", "cyrillic": "[а-яА-Я]"}
    script = F.coalesce(*[F.when(text.rlike(p), s) for s, p in scripts.items()], F.lit("latin")).alias("script")
    docs = load(spark, sf_dir, "documents").select("doc_id", script).dropDuplicates(["doc_id"])
    place = ["doc_id", "start_pos", "end_pos"]
    tagged = [f.select(*place).distinct().withColumn("mark", F.lit(m)) for f, m in ((p8_found(spark, sf_dir), 1), (p8_method(spark, sf_dir), 2))]
    marks = tagged[0].unionByName(tagged[1]).groupBy(*place).agg(F.sum("mark").alias("marks"))
    m = F.col("marks")
    return marks.join(docs, "doc_id").groupBy("script").agg(F.count_if(m != 2).alias("n_found"), F.count_if(m >= 2).alias("n_method"), F.count_if(m == 3).alias("n_both"))
