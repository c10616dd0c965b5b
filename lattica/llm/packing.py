"""Filling containers of fixed capacity with texts: best-two-fit over counts of token lengths."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources.tables import load, materialize

CAPACITY = 2048
#: Where the public tokenizers lie, and which one measures texts, unless spark.lattica.tokenizer names another file.
TOKENIZER_FOLDER = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Pattern by which the tokenizer cuts a text before it merges, fixed value.
TOKENIZER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of one token length that one task ranks at most, on average.
ROWS_PER_RANK_TASK = 500_000


@lru_cache(2)
def tokenizer(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, read once a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=TOKENIZER_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = f"{TOKENIZER_FOLDER}/{TOKENIZER}") -> DataFrame:
    """(doc_id, n_tokens) of each row of ``docs`` (doc_id, text): the whole text's tokens, 0 for a null or empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_to_numpy
        for batch in batches:
            n = [len(encode(t, disallowed_special=())) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, docs.select("doc_id").schema.add("n_tokens", T.LongType()))


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Containers for ``counts[size]`` items of each size up to ``capacity``: a list of (repetitions, {size: items}).

    Each container is filled greedily, with the largest item that still fits until none does. Then its smallest item is
    taken out again if two items not yet packed fill the larger gap better than it did; the best such pair is taken.
    What a container gets depends only on the sizes there are, so it is repeated for as long as the items last: the work
    grows with the number of sizes, not of items.
    """
    left = {int(s): int(c) for s, c in enumerate(counts) if s and c}
    sizes = sorted(left)
    array = np.array(sizes)
    out = []
    while sizes:
        gap, items = capacity, {}
        while True:
            i = bisect_right(sizes, gap) - 1
            while i >= 0 and left[sizes[i]] == items.get(sizes[i], 0):
                i = bisect_right(sizes, sizes[i] - 1) - 1
            if i < 0:
                break
            s = sizes[i]
            n = min(gap // s, left[s] - items.get(s, 0))
            items[s] = items.get(s, 0) + n
            gap -= n * s
        if gap and items:
            small = min(items)
            room = gap + small
            free = array[: bisect_right(sizes, room - 1)]
            free = free[[left[s] > items.get(s, 0) for s in free.tolist()]] if len(free) else free
            if len(free):
                # The best partner of each free item; an item may be its own partner if there are two of it.
                j = np.searchsorted(free, room - free, "right") - 1
                partner = np.where(j >= 0, free[j], 0)
                own = (partner == free) & np.array([left[s] - items.get(s, 0) < 2 for s in free.tolist()])
                partner = np.where(own, np.where(j > 0, free[np.maximum(j - 1, 0)], 0), partner)
                total = np.where((j >= 0) & (partner > 0), free + partner, 0)
                k = int(total.argmax())
                if total[k] > small:
                    items[small] -= 1
                    for s in (int(free[k]), int(partner[k])):
                        items[s] = items.get(s, 0) + 1
                    items = {s: n for s, n in items.items() if n}
        times = min(left[s] // n for s, n in items.items())
        out.append((times, items))
        gone = False
        for s, n in items.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
                sizes.remove(s)
                gone = True
        if gone:
            array = np.array(sizes)
    return out


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers for rows (doc_id, n_tokens): doc_id, piece_no, token_start, token_end, n_tokens, container_id.

    A text longer than ``capacity`` is cut into full pieces and a rest, no other is cut. A doc_id that comes again is the
    same text and counts once; rows without one are texts of their own. A text without tokens has one row with a null
    container. Only the number of pieces per length, at most ``capacity`` rows, goes to the driver. What it decides is a
    list of ranges: the pieces of a length, in order of rank, fill its places in the containers. Ranks are counted within
    hash parts of a length, so no length, however frequent, meets in one task. ``sizes`` is read thrice: materialize it.
    """
    once = sizes.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")).unionByName(sizes.filter("doc_id is null"))
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece_no")
    pieces = once.select("doc_id", "n_tokens", cut).select("doc_id", "piece_no", (F.col("piece_no") * F.lit(capacity).cast("bigint")).alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("size"))
    pieces = materialize(pieces)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pieces.filter("size > 0").groupBy("size").count().collect():
        counts[size] = n
    begin, rank, used, base = [], np.zeros(capacity + 1, np.int64), [], []
    first = 0
    for times, items in best_two_fit(counts, capacity):
        for s, n in items.items():
            begin.append((s << 44) + rank[s])
            used.append(n)
            base.append(first)
            rank[s] += times * n
        first += times
    order = np.argsort(np.array(begin, np.int64))
    begin_a, used_a, base_a = (np.array(x, np.int64)[order] for x in (begin, used, base))
    parts = max(1, -(-int(counts.sum()) // ROWS_PER_RANK_TASK))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int"))
    ranked = salted.filter("size > 0").withColumn("rank", F.row_number().over(Window.partitionBy("size", "part").orderBy("doc_id", "piece_no")).cast("bigint") - 1)
    if parts > 1:
        per = salted.filter("size > 0").groupBy("size", "part").count()
        before = F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.join(per.select("size", "part", before.alias("before")), ["size", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = (np.array(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("size", "rank"))
            key = (size << 44) + at
            i = np.searchsorted(begin_a, key, "right") - 1
            container = base_a[i] + (key - begin_a[i]) // used_a[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container)], [*batch.schema.names[:4], "container_id"])

    columns = ["doc_id", "piece_no", "token_start", "size"]
    placed = ranked.select(*columns, "rank").mapInArrow(place, ranked.select(*columns).schema.add("container_id", T.LongType()))
    empty = pieces.filter("size <= 0").select(*columns, F.lit(None).cast("bigint").alias("container_id"))
    return placed.unionByName(empty).select("doc_id", "piece_no", "token_start", (F.col("token_start") + F.col("size")).alias("token_end"), F.col("size").alias("n_tokens"), "container_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    path = spark.conf.get("spark.lattica.tokenizer", f"{TOKENIZER_FOLDER}/{TOKENIZER}")
    return pack(materialize(token_counts(docs, path)))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, the fewest containers the tokens could fill, and the share of capacity used."""
    totals = p6_containers(spark, sf_dir).filter("container_id is not null").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return totals.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / CAPACITY).alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * CAPACITY), 6).alias("fill"))
