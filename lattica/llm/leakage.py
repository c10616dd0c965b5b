"""Evaluation texts leaking into training text: phrases of the test items searched in an FM-index per shard of documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.fm_index import FMIndex
from lattica.sources.tables import load

#: Scripts written without spaces, each character of which is a word here: Thai, kana, ideographs. Fixed values.
_ALONE = "฀-๿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿"
_SPACELESS = re.compile(f"[{_ALONE}]")
_WORDS = re.compile(rf"[{_ALONE}]|[^\W_{_ALONE}]+")
#: Characters that show nothing: soft hyphen, zero width marks, byte order mark. Fixed values.
_UNSEEN = ("­", "​", "‌", "‍", "⁠", "﻿")
#: Words of a searched phrase; twice as many in an item written mostly without spaces, where a word is one character.
PHRASE = 3
#: Share of an item's characters that a document must hold.
LEAST_SHARE = 0.5
#: Altered words in a row that a match passes over: single ones.
ALTERED = 1
#: Words between places that still are neighbours.
NEIGHBOURS = 400
#: Symbols of a shard; a longer document is a shard of its own.
SHARD = 1 << 20
#: Words of the test items searched in one pass over the documents.
ITEM_WORDS = 4_000_000
#: Phrases searched at a time, and the items above which a phrase is a stock phrase.
SEARCHED, STOCK = 500_000, 16


def words(text: str | None) -> list[str]:
    """Words of a text without regard to case, punctuation, spacing and Unicode form."""
    if not text:
        return []
    if not text.isascii():
        for c in _UNSEEN:
            if c in text:
                text = text.replace(c, "")
        text = unicodedata.normalize("NFKC", text)
    return _WORDS.findall(text.casefold())


class Phrases:
    """The distinct phrases of a block of test items, and where in which items they stand."""

    def __init__(self, items: list[tuple[int, str]], phrase: int = PHRASE) -> None:
        self.ids = [i for i, _ in items]
        texts = [words(t) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t], np.int64) for t in texts]
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.weights = [np.array([len(w) for w in t], float) for t in texts]
        self.start = np.cumsum([0, *map(len, texts)])
        self.all_weights = np.concatenate([np.zeros(0), *self.weights])
        self.totals = np.array([w.sum() for w in self.weights])
        # Items shorter than a phrase are one phrase each.
        seen: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (t, c) in enumerate(zip(texts, coded, strict=True)):
            spaceless = 2 * sum(len(w) == 1 and _SPACELESS.match(w) is not None for w in t) > len(t)
            size = min(phrase * (1 + spaceless), len(c))
            for i in range(len(c) - size + 1 if size else 0):
                seen.setdefault(tuple(c[i : i + size].tolist()), []).append((k, i))
        self.groups = []
        for size in sorted({len(p) for p in seen}):
            own = [(p, at) for p, at in seen.items() if len(p) == size]
            flat = np.array([x for _, at in own for x in at], np.int64).reshape(-1, 2)
            self.groups.append((np.array([p for p, _ in own], np.int64), np.cumsum([0, *(len(at) for _, at in own)]), flat))
        # What the stock phrases of an item cover, with words passed over: if that is less than the least share, its other
        # phrases must match too.
        covered = np.zeros(self.start[-1] + 1, bool)
        for phrases, bounds, uses in self.groups:
            stock = uses[np.repeat(np.diff(bounds) > STOCK, np.diff(bounds))]
            for d in range(phrases.shape[1] + ALTERED):
                covered[np.minimum(self.start[stock[:, 0]] + stock[:, 1] + d, self.start[stock[:, 0] + 1] - 1)] = True
        reach = np.concatenate([[0.0], np.cumsum(self.all_weights * covered[:-1])])
        self.by_stock = (reach[self.start[1:]] - reach[self.start[:-1]]) / np.maximum(self.totals, 1)

    def code(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text)], np.int32)


def shared(item: np.ndarray, place: np.ndarray, size: int, weights: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Share of an item's characters that matched phrases cover in order and in neighbouring places, and these places.

    ``item`` and ``place`` are the words of the item and the document at which phrases of ``size`` words match. Matches
    on a diagonal join to a stretch, over up to ``ALTERED`` altered words; then the heaviest ascending chain of stretches
    counts, each beginning within ``NEIGHBOURS`` words of the end of the one before.
    """
    order = np.lexsort((item, place - item))
    item, place = item[order], place[order]
    same = (np.diff(place - item) == 0) & (np.diff(item) <= size + ALTERED)
    first = np.flatnonzero(np.append(True, ~same))
    last = np.append(first[1:], len(item)) - 1
    total = np.append(0.0, np.cumsum(weights))
    runs = sorted(zip(place[first].tolist(), item[first].tolist(), (place[last] + size).tolist(), (item[last] + size).tolist(), strict=True))
    best: list[float] = []
    came: list[int] = []
    near: list[int] = []
    for k, (p0, i0, p1, i1) in enumerate(runs):
        gain = total[i1] - total[i0]
        top, back = gain, -1
        # Stretches too far behind are behind for all that follow, so each meets only those of its neighbourhood.
        near = [j for j in near if p0 - runs[j][2] <= NEIGHBOURS]
        for j in near:
            _, _, q1, j1 = runs[j]
            # Stretches may touch by a word or two of both; what overlaps counts once.
            over = max(0, j1 - i0, q1 - p0)
            if i1 > j1 and p1 > q1 and over < i1 - i0:
                joined = best[j] + total[i1] - total[i0 + over]
                if joined > top:
                    top, back = joined, j
        best.append(top)
        came.append(back)
        near.append(k)
    at = int(np.argmax(best)) if best else -1
    share, chain = (best[at] / total[-1] if best else 0.0), []
    while at >= 0:
        chain.append((runs[at][0], runs[at][2]))
        at = came[at]
    return share, chain[::-1]


def _uses(doc: np.ndarray, place: np.ndarray, phrase: np.ndarray, bounds: np.ndarray, uses: np.ndarray, group: int) -> np.ndarray:
    """Columns (document, item, place in the item, place, group) of each occurrence of a phrase with each of its uses in items."""
    used = np.diff(bounds)[phrase]
    use = np.arange(int(used.sum())) - np.repeat(np.cumsum(used) - used, used) + np.repeat(bounds[phrase], used)
    return np.stack([np.repeat(doc, used), uses[use, 0], uses[use, 1], np.repeat(place, used), np.full(len(use), group)])


class Shard:
    """Documents whose index is built and searched when it is full."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, code: np.ndarray) -> None:
        self.codes.append(code)
        self.size += len(code) + 1

    def found(self, least: float) -> Iterator[tuple[int, int, float, list[tuple[int, int]]]]:
        """(document's number in the shard, item's number, share, places in words) of each pair that shares at least ``least`` of the item."""
        lengths = np.array([len(c) + 1 for c in self.codes])
        symbols = np.zeros(int(lengths.sum()), np.int64)
        starts = np.cumsum(lengths) - lengths
        for s, c in zip(starts.tolist(), self.codes, strict=True):
            symbols[s : s + len(c)] = c
        # A run of words that no item has is one separator.
        kept = np.flatnonzero((symbols > 0) | np.append(True, symbols[:-1] > 0))
        symbols = symbols[kept]
        if not symbols.any():
            return
        index = FMIndex(np.append(symbols, 0), self.phrases.bits)
        n = len(self.phrases.ids)
        stocked = self.phrases.by_stock >= least
        rows, stock = [], []
        for k, (phrases, bounds, uses) in enumerate(self.phrases.groups):
            for low_phrase in range(0, len(phrases), SEARCHED):
                low, high = index.search(phrases[low_phrase : low_phrase + SEARCHED])
                count = high - low
                hit = np.repeat(np.arange(len(low)), count)
                row = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + low[hit]
                phrase, place = hit + low_phrase, kept[index.locate(row)]
                doc = np.searchsorted(starts, place, "right") - 1
                many = np.diff(bounds)[phrase] > STOCK
                rows.append(_uses(doc[~many], place[~many], phrase[~many], bounds, uses, k))
                if many.any():
                    stock.append((k, doc[many], place[many], phrase[many]))
        # Stock phrases stand in many items: their matches are taken for the items that consist of them, and for pairs
        # that other phrases have met. No other pair can reach the least share.
        met = np.unique(np.concatenate([r[0] * n + r[1] for r in rows]))
        for k, doc, place, phrase in stock:
            phrases, bounds, uses = self.phrases.groups[k]
            for low_row in range(0, len(doc), 4096):
                part = _uses(*(x[low_row : low_row + 4096] for x in (doc, place, phrase)), bounds, uses, k)
                pair = part[0] * n + part[1]
                at = np.minimum(np.searchsorted(met, pair), max(len(met) - 1, 0))
                rows.append(part[:, stocked[part[1]] | ((met[at] == pair) if len(met) else False)])
        doc, item, at, place, group = np.concatenate(rows, axis=1)
        pair = doc * n + item
        order = np.argsort(pair, kind="stable")
        pair, at, place, group = pair[order], at[order], place[order], group[order]
        if not len(pair):
            return
        heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        tails = np.append(heads[1:], len(pair))
        pairs = pair[heads]
        # What a pair could share at most: all words under a match or near enough to be passed over, in whatever order.
        sizes = np.array([g[0].shape[1] for g in self.phrases.groups])[group]
        reach = int(sizes.max()) + ALTERED
        length = np.diff(self.phrases.start)[pair % n]
        word = np.repeat(at, reach) + np.tile(np.arange(reach), len(at))
        cell = np.repeat(np.repeat(np.arange(len(heads)), tails - heads), reach)
        inside = word < np.repeat(length, reach)
        cell, word = cell[inside], word[inside]
        wide = int(length.max())
        once = np.unique(cell * wide + word)
        cell, word = once // wide, once % wide
        weight = self.phrases.all_weights[self.phrases.start[pairs[cell] % n] + word]
        most = np.bincount(cell, weights=weight, minlength=len(heads)) / self.phrases.totals[pairs % n]
        for k in np.flatnonzero(most >= least).tolist():
            a, b = int(heads[k]), int(tails[k])
            share, places = shared(at[a:b], place[a:b], int(sizes[a]), self.phrases.weights[int(pairs[k] % n)])
            if share >= least:
                d = int(pairs[k] // n)
                yield d, int(pairs[k] % n), share, [(p - int(starts[d]), q - int(starts[d])) for p, q in places]


def word_places(text: str) -> list[tuple[int, int]]:
    """Start and end in code points of each word that ``words`` finds in a text."""
    norm, origin = [], []
    at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        if text[at] not in _UNSEEN:
            part = unicodedata.normalize("NFKC", text[at:end]).casefold()
            norm.append(part)
            origin += [(at, end)] * len(part)
        at = end
    return [(origin[m.start()][0], origin[m.end() - 1][1]) for m in _WORDS.finditer("".join(norm))]


def leaks(docs: DataFrame, items: list[tuple[int, str]], least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, share, spans) of the documents (doc_id, text) that hold at least ``least`` of an item's text.

    ``spans`` are the places of the item's parts in the document, in code points. Each task indexes its documents in shards
    and searches all phrases of the items in each. A document is indexed whole. A null or empty text holds nothing. An
    item without words is in no document.
    """
    phrases = Phrases([(i, t) for i, t in items if words(t)])
    ids = np.array(phrases.ids, np.int64)
    span = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, texts = Shard(phrases), [], []

        def flush() -> pa.RecordBatch:
            rows, places = [], {}
            for d, i, share, runs in shard.found(least):
                if d not in places:
                    places[d] = word_places(texts[d])
                at = places[d]
                rows.append((names[d], int(ids[i]), share, [{"start_pos": at[p][0], "end_pos": at[min(q, len(at)) - 1][1]} for p, q in runs if p < len(at)]))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(span)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "share", "spans"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                texts.append(text)
                shard.add(phrases.code(text))
                if shard.size >= SHARD:
                    yield flush()
                    shard, names, texts = Shard(phrases), [], []
        if names:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, item_id bigint, share double, spans array<struct<start_pos:int,end_pos:int>>")


def merged_spans(found: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, n_items): what to remove from each document, overlapping spans of all its items joined.

    A span begins where no earlier one of the document reaches: the largest end so far tells. A document's spans are few,
    as they lie side by side in its text.
    """
    s = found.select("doc_id", "item_id", F.explode("spans").alias("s")).select("doc_id", "item_id", "s.start_pos", "s.end_pos").distinct()
    w = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos", "item_id")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = s.withColumn("opens", (reach.isNull() | (F.col("start_pos") > reach)).cast("int"))
    run = opened.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count_distinct("item_id").alias("n_items")).drop("run")


def all_leaks(spark: SparkSession, sf_dir: str, least: float = LEAST_SHARE) -> DataFrame:
    """``leaks`` of all test items; up to ``ITEM_WORDS`` words of them are searched in one pass over the documents.

    The test items, unlike the documents, pass through the driver. An item_id that comes again is the same item.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    blocks: list[list[tuple[int, str]]] = [[]]
    held = 0
    for r in load(spark, sf_dir, "eval_items").select("item_id", "text").dropDuplicates(["item_id"]).orderBy("item_id").toLocalIterator():
        size = len(words(r.text))
        if held and held + size > ITEM_WORDS:
            blocks.append([])
            held = 0
        blocks[-1].append((r.item_id, r.text))
        held += size
    return reduce(DataFrame.unionByName, [leaks(docs, b, least) for b in blocks])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_spans(all_leaks(spark, sf_dir))
