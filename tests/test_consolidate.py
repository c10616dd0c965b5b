import random
from collections import defaultdict
from datetime import datetime as D
from datetime import timedelta

import pytest

from lattica.operators import consolidate as C

FILES = "file_id bigint, output_file_full_path string, top_left string, n_bytes bigint, content_crc bigint, written_at timestamp, level string"


def found(spark, rows, **sizes):
    runs, merged = C.consolidation(C.tile_files(spark.createDataFrame(rows, FILES)), **sizes)
    return runs, merged.collect(), {r.file_id for r in C.left_out(runs, merged).collect()}


def test_current_tiles(spark):
    t = lambda d: D(2021, 1, d)
    rows = [
        (1, "/a/001/X.png", None, 5, 1, t(1), ""), (2, "\\b\\001\\x.PNG ", None, 6, 2, t(2), ""), (3, "/a/001/x.png", None, 0, 3, t(3), ""), (4, "/a/002/x.png", "/q/001/x.png", 9, 4, t(1), ""),
        (5, "/a/001/y.png", None, 0, 5, t(1), ""), (6, "/a/001/z.png", None, 7, 6, t(1), ""), (7, "/b//001/z.png", None, 8, 7, t(1), ""), (2, "\\b\\001\\x.PNG ", None, 6, 2, t(2), ""),
        (8, None, None, 3, 1, t(1), ""), (9, "/a/001/z.png", None, None, 1, t(9), ""), (10, "/a/001/z.png", None, 4, 1, None, ""), (11, " ", None, 4, 1, t(1), ""),
    ]
    _, merged, left = found(spark, rows)
    assert sorted((r.tile, r.file_id) for r in merged if r.current) == [("001/x.png", 2), ("001/z.png", 7), ("002/x.png", 4)]
    assert left == {1, 3, 5, 6, 8, 9, 10, 11}
    assert found(spark, rows[:0]) [1:] == ([], set())


@pytest.mark.parametrize(("run_rows", "range_rows"), [(100_000, 100_000), (300, 100_000), (300, 400), (50, 37)])
def test_merge_like_brute_force(spark, run_rows, range_rows):
    random.seed(run_rows + range_rows)
    rows, start = [], D(2022, 1, 1)
    for i in range(6000):
        name = "001/hot.png" if i % 3 == 0 else f"{random.choice(['001', '002', '002-b', 'é'])}/{random.randint(0, 400)}.png"
        row = (i, f"/s/{name}", None, random.choice([0, 1, 7, 900]), i, start + timedelta(hours=random.randint(0, 500)), "")
        rows += [row] * (1 + (i % 9 == 0))
    random.shuffle(rows)
    runs, merged, left = found(spark, rows, run_rows=run_rows, range_rows=range_rows)
    best = {}
    for r in set(rows):
        if r[3]:
            best[r[1][3:]] = max(best.get(r[1][3:], (D.min, -1, 0)), (r[5], r[0], r[3]))
    assert {r.tile: r.file_id for r in merged if r.current} == {t: b[1] for t, b in best.items()}
    assert left == {r[0] for r in rows} - {b[1] for b in best.values()}
    assert sum(r.current for r in merged) == len(best)
    by = defaultdict(list)
    for r in C.roll_by_bytes(C.merge_runs(runs, C.range_bounds(runs, range_rows)), 1000).collect():
        by[r.level].append(r)
    assert sum(map(len, by.values())) == len(best)
    for placed in by.values():
        placed.sort(key=lambda r: r.byte_offset)
        assert [r.tile for r in placed] == sorted(r.tile for r in placed)
        at = 0
        for r in placed:
            assert r.byte_offset == at and r.file_no == at // 1000
            at += r.n_bytes
