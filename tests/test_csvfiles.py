"""The splittable CSV reader against pandas: quoted line ends over many byte ranges, a header per file, errors."""

import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.session import scratch_path
from quillspark.sources import csvfiles as C
from quillspark.sources.tables import read_csv, read_prediction_dir
from quillspark.targets import TARGETS


@pytest.fixture
def small_splits(spark):
    """Byte ranges of about 300 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def folder(spark, files: dict[str, str | bytes]) -> str:
    path = scratch_path(spark, "csvfiles").removeprefix("file:")
    import os
    os.makedirs(path)
    for name, text in files.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(text.encode() if isinstance(text, str) else text)
    return path


def essays(rng: random.Random, n: int) -> pd.DataFrame:
    piece = ["plain words", "a \"quoted\" part", "comma, and\nline", "\n\n", "\"", "\",\"", "ends with ,", "\r\n", "é 日本", ",3.0\n\"x\",", ""]
    text = ["".join(rng.choice(piece) for _ in range(rng.choice([1, 2, 5, 40]))) for _ in range(n)]
    return pd.DataFrame({"text_id": [f"T{i:04d}" for i in range(n)], "full_text": text, "x": [rng.random() for _ in range(n)],
                         "n": [rng.randrange(100) for _ in range(n)]})


def rows_of(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


def of_pandas(pdf: pd.DataFrame) -> list[tuple]:
    return sorted((a, b, c, d) for a, b, c, d in zip(pdf.text_id, pdf.full_text, pdf.x.tolist(), pdf.n.tolist()))


SCHEMA = "text_id string, full_text string, x double, n long"


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("few_blocks", [C.FEW_BLOCKS, 0])
def test_many_tasks_read_what_one_reads(spark, small_splits, ends, few_blocks, monkeypatch):
    pdf = essays(random.Random(1), 120)
    pdf["full_text"] = pdf["full_text"].str.replace("\r\n", "\r\n" if ends == "\n" else "\n")
    buf = io.StringIO()
    pdf.to_csv(buf, index=False, lineterminator=ends, quoting=0)
    path = folder(spark, {"a.csv": buf.getvalue()})
    assert C._lines(spark, path).rdd.getNumPartitions() > 20
    records = C.read_records(spark, path, few_blocks)
    got = sorted((r["r"][0], r["r"][1] or "", float(r["r"][2]), int(r["r"][3])) for r in records.collect())
    assert got == of_pandas(pdf)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100m")
    assert [(a, b or "", c, d) for a, b, c, d in rows_of(read_csv(spark, path, SCHEMA))] == of_pandas(pdf)


def test_headers_differ_by_file(spark, small_splits):
    """Other orders, an index column, a column less, forty more, a byte order mark: each file by its own header."""
    rng = random.Random(2)
    parts = [essays(rng, 30) for _ in range(5)]
    for i, p in enumerate(parts):
        p["text_id"] = f"{i}-" + p["text_id"]
    wide = parts[3].copy()
    for j in range(40):
        wide.insert(rng.randrange(3), f"other{j}", [f"v{j}\n,{i}" for i in range(30)])
    path = folder(spark, {"a.csv": parts[0].to_csv(index=False), "b.csv": parts[1][["n", "x", "full_text", "text_id"]].to_csv(index=False),
                          "c.csv": parts[2].to_csv(), "d.csv": wide.to_csv(index=False), "e.csv": b"\xef\xbb\xbf" + parts[4].to_csv(index=False).encode(),
                          "f.csv": "text_id,n\nonly,7\n", "empty.csv": "", "head.csv": "text_id,full_text\n"})
    got = [(a, b or "", c, d) for a, b, c, d in read_csv(spark, path, SCHEMA).collect()]
    assert ("only", "", None, 7) in got
    assert sorted(r for r in got if r[0] != "only") == of_pandas(pd.concat(parts))


def test_null_and_empty_and_blank_lines(spark):
    path = folder(spark, {"a.csv": 'a,b,c\n1,,""\n\n"2","x\n\ny",\n'})
    assert rows_of(read_csv(spark, path, "a int, b string, c string, d string").fillna("NULL")) == [(1, "NULL", "", "NULL"), (2, "x\n\ny", "NULL", "NULL")]
    assert read_csv(spark, path).dtypes == [("a", "bigint"), ("b", "string"), ("c", "string")]


@pytest.mark.parametrize("text,why", [
    ("a,b\n1,2\n3,4,5\n", "a record of 3 fields"), ("a,b\n1\n", "a record of 1 fields"), ('a,b\n1,2\n5" disk,2\n3,"x\ny"\n7,"z"\n', "quote|expected|record of|inside"),
    ('a,b\n1,"x"y\n', "expected after"), ('a,b\n1,"never closed\n2,3\n', "ends inside quotes"), ('a,"b\nc"\n1,2\n', "header record holds a line end"),
    ("a,b\n1,x\n", "CAST_INVALID_INPUT|cast")])
def test_malformed_files_raise(spark, text, why):
    path = folder(spark, {"good.csv": "a,b\n1,2\n", "x.csv": text})
    with pytest.raises(Exception, match=why):
        read_csv(spark, path, "a int, b int").collect()


def test_prediction_folder_of_any_width(spark, small_splits):
    """More than twice the targets in columns, targets at the end: nothing is cut off."""
    rng = random.Random(3)
    n = 20
    base = pd.DataFrame({"text_id": [f"t{i}" for i in range(n)], "full_text": ["a\n\"b\", c" * 9] * n})
    for j in range(30):
        base[f"feature{j}"] = j
    for t in TARGETS:
        base[t] = 3.0
        base[f"pred_{t}"] = [round(rng.uniform(1, 5), 3) for _ in range(n)]
    base["fold"] = 2
    named = base[["full_text", "text_id", *TARGETS[::-1]]]
    path = folder(spark, {"model2.csv": base.to_csv(index=False), "exp02.csv": named.to_csv()})
    got = {(r["model_id"], r["text_id"]): r for r in read_prediction_dir(spark, f"{path}/*.csv").collect()}
    assert len(got) == 2 * n
    for i in range(n):
        assert [got["model2", f"t{i}"][t] for t in TARGETS] == [base[f"pred_{t}"][i] for t in TARGETS]
        assert got["model2", f"t{i}"]["fold"] == 2 and got["exp02", f"t{i}"]["fold"] is None
        assert [got["exp02", f"t{i}"][t] for t in TARGETS] == [3.0] * 6
    with pytest.raises(Exception, match="no column text_id"):
        read_prediction_dir(spark, folder(spark, {"m.csv": "id,cohesion\n1,2\n"}) + "/*.csv").collect()


def test_lines_are_not_shuffled_with_few_blocks(spark, small_splits):
    path = folder(spark, {"a.csv": essays(random.Random(4), 40).to_csv(index=False)})
    plan = read_csv(spark, path, SCHEMA).select(F.col("text_id"))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("MapInArrow _parsed" if "MapInArrow _parsed" in plan else "MapInArrow")[1]
    assert "SortMergeJoin" not in lines.split("MapInArrow")[0]


def test_lines_of_cut_files_are_not_shuffled(spark, small_splits):
    """Blocks that begin inside quotes are read for fragments; their lines are picked by the block states, without a shuffle."""
    pdf = essays(random.Random(8), 60)
    path = folder(spark, {"a.csv": pdf.to_csv(index=False), "b.csv": "text_id,full_text,x,n\nT,plain,1.0,2\n"})
    blocks = C.blocks_of(spark, f"{path}/*.csv").select("file", "cut", "inside").collect()
    assert {b["file"].rsplit("/", 1)[1]: b["cut"] for b in blocks} == {"a.csv": True, "b.csv": False}
    plan = C.read_records(spark, f"{path}/*.csv")._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(plan) if "FileScan text" in line]
    assert len(scans) == 2
    for i in scans:                                         # up the tree as far as the parser
        depth, above = plan[i].index("FileScan"), []
        for line in reversed(plan[:i]):
            at = len(line) - len(line.lstrip(" :+-"))
            if at < depth:
                depth = at
                above.append(line.lstrip(" :+-"))
            if above and above[-1].startswith("MapInArrow"):
                break
        assert above[-1].startswith("MapInArrow") and not any(x.startswith("Exchange") for x in above), above
    got = rows_of(read_csv(spark, f"{path}/*.csv", SCHEMA))
    assert got == sorted([*of_pandas(pdf), ("T", "plain", 1.0, 2)])


@pytest.mark.parametrize("most", [C.SHORT_HEADERS, 0])
def test_records_meet_their_headers_without_a_shuffle(spark, small_splits, monkeypatch, most):
    """Parsed records stay where they are up to the result; with headers too long to send, they are shuffled to the same rows."""
    monkeypatch.setattr(C, "SHORT_HEADERS", most)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as with files whose sizes promise no small table
    pdf = essays(random.Random(9), 60)
    path = folder(spark, {"a.csv": pdf.to_csv(index=False), "b.csv": "text_id,full_text,x,n\nT,plain,1.0,2\n"})
    try:
        plan = C.read_records(spark, f"{path}/*.csv")._jdf.queryExecution().executedPlan().toString().splitlines()
        got = sorted((a, b or "", c, d) for a, b, c, d in read_csv(spark, f"{path}/*.csv", SCHEMA).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    scans = [i for i, line in enumerate(plan) if "FileScan text" in line]
    shuffled = []
    for i in scans:                                         # up the tree as far as the result
        depth, above = plan[i].index("FileScan"), []
        for line in reversed(plan[:i]):
            at = len(line) - len(line.lstrip(" :+-"))
            if at < depth:
                depth = at
                above.append(line.lstrip(" :+-"))
        assert any(x.startswith("MapInArrow") for x in above)
        shuffled.append(any(x.startswith("Exchange") for x in above))
    assert sorted(shuffled) == ([False, True] if most else [True, True])     # fragments of cut records are joined in a shuffle
    assert got == sorted([*of_pandas(pdf), ("T", "plain", 1.0, 2)])
