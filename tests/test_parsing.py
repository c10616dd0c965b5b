import csv
import io
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.operators import parsing as P

NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)


def brute_transform(text):
    """The rule, word by word."""
    k = re.split(r"[ \t\n\v\f\r]+", text or "")
    k = [x for x in k if x]
    if not k or k[0] not in P.TRANSFORM_TYPES or len(k) < 3 or k[1] != "vp" or not re.fullmatch("[0-9]+", k[2]) or "fp" not in k[2:]:
        return "invalid_value"
    i = k.index("fp", 2)
    if i + 1 >= len(k) or not re.fullmatch("[0-9]+", k[i + 1]):
        return "invalid_value"
    v, f = k[3:i], k[i + 2 :]
    num = lambda x: float(x) if NUMBER.fullmatch(x) and abs(float(x)) < P.NUMBER_LIMIT else None
    w, m = P.TRANSFORM_TYPES[k[0]]
    if int(k[2]) != len(v) or int(k[i + 1]) != len(f) or len(f) != m:
        return "column_count"
    if w is None:
        q = [num(f[1]), num(f[2])] if m == 7 else [num(f[7])]
        w = None if None in q else 2 * (q[0] + 1) * (q[1] + 1) if m == 7 else 4 * q[0]
    if w is not None and w != len(v):
        return "column_count"
    return "invalid_value" if any(num(x) is None for x in v + f) else None


PARTS = ["Rigid2DTransform_double_2_2", "MeshTransform_double_2_2", "GridTransform_double_2_2", "CenteredSimilarity2DTransform_double_2_2", "vp", "fp", "3", "2", "0", "6", "1.5", "-2", ".5", "1e5", "1e", "+", "nan", "1.79769e308", "٣", "é"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14), min_size=1, max_size=5), st.sampled_from([" ", "\t", " \n "]))
def test_transforms_like_brute_force(tables, gap):
    texts = [gap.join(t) for t in tables] + ["Rigid2DTransform_double_2_2 vp 3 1 2 3 fp 2 4 5", None, ""]
    assert P.parse_transforms(pa.array(texts))["reason"].to_pylist() == [brute_transform(t) for t in texts]


def test_transform_values_and_offsets():
    got = P.parse_transforms(pa.array(["Rigid2DTransform_double_2_2 vp 3 1 -2.5 3e1 fp 2 4 .5", "Rigid2DTransform_double_2_2 vp 3 1 x 3 fp 2 4 5", "CenteredSimilarity2DTransform_double_2_2 vp 6 1 2 3 4 5 6 fp 0"]))
    assert got["vp"].to_pylist() == [[1, -2.5, 30], None, [1, 2, 3, 4, 5, 6]] and got["fp"].to_pylist() == [[4, 0.5], None, []]
    assert got["reason_offset"].to_pylist() == [None, 35, None]


def test_long_text_across_chunks():
    n = 40_000
    good = f"GridTransform_double_2_2 vp {2 * n} " + "12.5 " * (2 * n) + f"fp 7 0 {n - 1} 0 0 0 9 9"
    got = P.parse_transforms(pa.array([good, good.replace("12.5 ", "12.5x ", 1), good]))
    assert got["reason"].to_pylist() == [None, "invalid_value", None] and len(got["vp"][0]) == 2 * n


def brute_fields(line):
    line = line[:-1] if line.endswith("\r") else line
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"(?=,|\Z)').match(line, i)
            if not m:
                return None
            out.append(m[1].replace('""', '"'))
        else:
            m = re.compile(r'([^",]*)(?=,|\Z)').match(line, i)
            if not m:
                return None
            out.append(m[1])
        i = m.end()
        if i >= len(line):
            return out
        i += 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('ab",\r\né', max_size=12), min_size=1, max_size=6))
def test_records_like_brute_force(lines):
    lines = [x for x in lines if not x.endswith("\n")] or ["a"]
    assert P.tokenize_records(pa.array(lines))["fields"].to_pylist() == [brute_fields(x) for x in lines]


def test_records_round_trip():
    random.seed(3)
    rows = [["".join(random.choices('xy ,"\n', k=random.randint(0, 9))) for _ in range(4)] for _ in range(300)]
    lines = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(row)
        lines.append(out.getvalue())
    assert P.tokenize_records(pa.array(lines))["fields"].to_pylist() == rows


def test_chunks_do_not_matter():
    data = np.frombuffer(b'a,"b""c",d"e,"f' * 50, np.uint8)
    starts = np.arange(0, len(data), 15)
    want = P._QUOTES.run(data, starts, chunk=10_000)
    for chunk in (1, 7, 64):
        assert (P._QUOTES.run(data, starts, chunk=chunk) == want).all()


RIGID = "Rigid2DTransform_double_2_2 vp 3 1 2 3 fp 2 4 5"


def brute_record(line):
    """Reason of a raw record, column by column."""
    fields = brute_fields(line or "")
    if fields is None:
        return "quoting"
    want = {"stos": 8, "mosaic": 5}.get(fields[0])
    if want is None:
        return "invalid_value"
    if len(fields) != want:
        return "column_count"
    whole = lambda x: re.fullmatch(r"\s*\+?0*[1-9][0-9]*\s*", x, re.ASCII) is not None
    sizes = fields[5].split() if want == 8 else []
    wrong = not whole(fields[1]) or want == 8 and not (whole(fields[4]) and len(sizes) == 2 and all(map(whole, sizes)))
    inner = brute_transform(fields[6 if want == 8 else 3])
    return inner if inner == "column_count" or not wrong else "invalid_value"


COLUMN = st.sampled_from(["stos", "mosaic", "7", "0", "8", "51 52", "51", "a.png", RIGID, RIGID.replace("4", "x"), RIGID.replace("vp 3", "vp 4"), f'"{RIGID}"', '"x, ""y"""', 'b"c', '"open', ""])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["stos", "mosaic", "x"]), st.lists(COLUMN, max_size=9), st.booleans()), min_size=1, max_size=5))
def test_raw_records_like_brute_force(rows):
    lines = [",".join([kind, *rest]) + "\r" * cr for kind, rest, cr in rows]
    lines += [f"stos,7,a,b,8,51 52,{RIGID},r", f"mosaic,7,a,{RIGID},", None]
    got = P.parse_records(pa.array(lines))
    assert got["reason"].to_pylist() == [brute_record(x) for x in lines]
    assert [(o is None) == (r is None) for o, r in zip(got["reason_offset"].to_pylist(), got["reason"].to_pylist(), strict=True)]


def test_offsets_of_raw_records():
    bad = {
        f'stos,7,"é ""a""",b,8,51 52,"{RIGID.replace("2 3 fp", "x 3 fp")}",r': "x 3 fp",
        f"stos,0,a,b,8,51 52,{RIGID},r": "0,a",
        f"stos,1,a,b,z,51 52,{RIGID},r": "z,51",
        f"stos,1,a,b,8,51,{RIGID},r": "51,R",
        f"mosaic,1,i,{RIGID},r,more": "more",
        f"mosaic,1,i,{RIGID}": None,
        f"mosaic,1,i,{RIGID.replace('vp 3', 'vp 4')},": "4 1 2",
        "mosaic,1,i,Rigid2DTransform_double_2_2 vp,": ",\0",
        "none,1": "none",
        'mosaic,1,i"j,t,': '"j',
    }
    got = P.parse_records(pa.array([x.replace("\0", "") for x in bad]))
    for line, want, at in zip(bad, bad.values(), got["reason_offset"].to_pylist(), strict=True):
        here = len(line.encode()) if want is None else len(line) - 1 if want == ",\0" else line.encode().index(want.encode())
        assert at == here, (line, at, here)


def test_reasons(spark):
    lines = {
        f'stos,7,a.png,b.png,8,51 52,"{RIGID}","x, y"\r': None, 'stos,7,a.png,b.png,8,51 52,"x, y,r': "quoting", f"stos,0,a.png,b.png,8,51 52,{RIGID},r": "invalid_value", "mosaic,1,i,t": "column_count",
        f"mosaic,1,i,{RIGID},": None, f"Mosaic,1,i,{RIGID},": "invalid_value", "": "invalid_value", None: "invalid_value", f"stos,1,a,b,8,51,{RIGID},r": "invalid_value", 'mosaic,1,i"j,t,': "quoting",
        "mosaic,1,i,t,": "invalid_value", f"mosaic,0,i,{RIGID} 9,": "column_count",
    }
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, t string").withColumn("reason", P.F.lit("clash"))
    got = {r.raw_id: r.reason for r in P.with_records(df, "t").collect()}
    assert got == dict(enumerate(lines.values()))
    assert P.with_records(df.limit(0), "t").count() == 0
