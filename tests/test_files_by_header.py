"""CSV by header in one scan, inferred types, total order of files, and rows by their place in files."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import huestrata as hs
from huestrata.operators.columns import long_histogram
from huestrata.operators.images import pick_first_in_file
from huestrata.sources import files, shared
from huestrata.sources.files import csv_headers, read_typed_csv
from tests.helpers import histogram, hue_row
from tests.test_plans import plan, shuffles

PAIR = T.StructType([T.StructField("cores", T.IntegerType()), T.StructField("exectime", T.DoubleType())])


def jobs_of(spark, work):
    """Jobs that a piece of work starts."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        result = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def many_files(folder, count, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(count):
        names = rng.sample(["cores", "exectime", "note"], 3)
        lines = [{"cores": str(i), "exectime": f"{j}.5", "note": f'"a, {j}"'} for j in range(rng.randrange(3))]
        rows += [(i, float(line["exectime"])) for line in lines]
        text = "\n".join([",".join(names), *(",".join(line[n] for n in names) for line in lines)])
        (folder / f"f{i:04d}.csv").write_text(text + "\n")
    return sorted(rows)


def test_many_small_files_start_a_handful_of_jobs(spark, tmp_path):
    rows = many_files(tmp_path, 300)
    got, jobs = jobs_of(spark, lambda: sorted(map(tuple, read_typed_csv(spark, str(tmp_path), PAIR).collect())))
    assert got == rows and len(rows) > 200
    assert jobs <= 12


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_headers_are_met_by_join_whatever_their_number(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(shared.broadcast_if_small, "__defaults__", (most,))
    rows = many_files(tmp_path, 12, seed=most % 7)
    df = read_typed_csv(spark, str(tmp_path), PAIR)
    assert plan(df).count("FileScan csv") == 1
    assert sorted(map(tuple, df.collect())) == rows


def test_one_header_reads_the_named_columns_alone(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"note,cores,exectime\nx,{i},2\n")
    text = plan(read_typed_csv(spark, str(tmp_path), PAIR))
    assert "Join" not in text and "note" not in text[text.index("ReadSchema"):]


@pytest.mark.parametrize("long_file", [0, 60, 1 << 40])
def test_headers_of_short_and_long_files(spark, tmp_path, monkeypatch, long_file):
    """Short files share a task, long ones have one each; each file gives one header."""
    monkeypatch.setattr(files, "LONG_FILE", long_file)
    many_files(tmp_path, 12)
    got = {r.file.split("/")[-1]: r.header for r in csv_headers(spark, str(tmp_path)).collect()}
    want = {f.name: f.read_text().split("\n")[0].split(",") for f in tmp_path.glob("*.csv")}
    assert got == want


def test_awkward_headers(spark, tmp_path):
    made = {
        "bom.csv": "﻿cores,exectime\n1,2\n",
        "blank.csv": "\n\nCORES,note,ExecTime\n3,x,4\n",
        "quoted.csv": '"a, b","exectime","cores"\n9,6,5\n',
        "twice.csv": "cores,,exectime,note,Note\n7,x,8,y,z\n",
        "short.csv": "cores,exectime\n9\n",
        "header_only.csv": "exectime,cores\n",
        "empty.csv": "",
    }
    for name, text in made.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = sorted(map(tuple, read_typed_csv(spark, str(tmp_path), PAIR).collect()))
    assert got == [(1, 2.0), (3, 4.0), (5, 6.0), (7, 8.0), (9, None)]
    headers = {r.file.split("/")[-1]: r.header for r in csv_headers(spark, str(tmp_path)).collect()}
    assert headers["twice.csv"] == ["cores", "_c1", "exectime", "note3", "Note4"]
    assert headers["quoted.csv"] == ["a, b", "exectime", "cores"]
    assert "empty.csv" not in headers
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    with pytest.raises(ValueError):
        read_typed_csv(spark, str(tmp_path / "none"), PAIR)


def test_inferred_types_by_name_over_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,big,d,b,day,at,s,none\n1,2,3,true,2016-02-29,2016-02-29 10:00,x,NA\n")
    (tmp_path / "b.csv").write_text("s,at,day,b,d,big,i\n007,2016-03-01T11:00:30,NA,FALSE,1e3,3000000000, 5 \n")
    (tmp_path / "c.csv").write_text("i,s\n,12a\nNA,\n")
    df = hs.read_plain_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {
        "i": "int", "big": "bigint", "d": "double", "b": "boolean", "day": "date", "at": "timestamp", "s": "string",
        "none": "string",
    }
    rows = {r.s: r for r in df.collect()}
    assert rows["007"].i == 5 and rows["007"].big == 3_000_000_000 and rows["007"].d == 1000.0
    assert rows["007"].b is False and rows["x"].b is True and rows["12a"].i is None and len(rows) == 4


def test_files_in_name_order_hold_the_total_order(spark, tmp_path):
    """A key that holds half of the rows, and copies of whole rows, spread over several files."""
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, rng.randrange(99)]), rng.choice([1, 2, None])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    path = str(tmp_path / "out")
    hs.write_table(df, path, order=["a", "b"], total_order=True)
    parts = sorted((tmp_path / "out").glob("part-*.parquet"))
    read = [tuple(r) for f in parts for r in spark.read.parquet(str(f)).collect()]
    key = lambda r: (r[0], r[1] is not None, r[1] or 0)
    assert read == sorted(rows, key=key)
    sizes = [spark.read.parquet(str(f)).count() for f in parts]
    assert len(parts) > 1 and max(sizes) < 0.6 * len(rows)
    numbered = sorted((r.Row, r.a, r.b) for r in hs.read_numbered(spark, path).collect())
    assert [n for n, _, _ in numbered] == list(range(1, len(rows) + 1))
    assert [r[1:] for r in numbered] == read
    with pytest.raises(ValueError):
        hs.write_table(df, path, total_order=True)


def test_total_order_by_folder(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 3).alias("Year"), (-F.col("id")).alias("v"))
    hs.write_table(df, str(tmp_path / "t"), by=["Year"], order=["v"], total_order=True)
    got = hs.read_numbered(spark, str(tmp_path / "t")).orderBy("Row").collect()
    assert [(r.Year, r.v) for r in got] == sorted((i % 3, -i) for i in range(300))


def minutes(df):
    return sorted({(r.Day, r.Hour, r.Minute, r.Bin, r.Bin_Value) for r in df.collect()})


def test_first_image_by_its_place_in_files(spark, tmp_path):
    """The file names decide first, then the line; the minute does not."""
    names = "Dataset,Camera_ID,Year,Day,Hour,Minute,Metric_Type,HSV_Bin,HSV_H"
    (tmp_path / "b.csv").write_text(names + "\nd,c1,2016,1,9,0,HSV,0,5\n")
    lines = ["d,c1,2016,1,9,45,HSV,10,7", "d,c2,2016,1,9,30,HSV,0,1", "d,c1,2016,1,9,45,HSV,20,8", "d,c1,2016,1,9,45,HSV,20,9"]
    (tmp_path / "a.csv").write_text("\n".join([",".join(names.split(",")), *lines]) + "\n")
    for shuffled in (False, True):
        if shuffled:
            (tmp_path / "b.csv").write_text("Minute," + names.replace("Minute,", "") + "\n0,d,c1,2016,1,9,HSV,0,5\n")
        hist = hs.read_histogram_csv(spark, str(tmp_path), place="at")
        long = long_histogram(hist, extra=("at",)).repartition(3)
        pooled = pick_first_in_file(long, place="at", series=("Dataset",))
        assert minutes(pooled) == [(1, 9, 45, 10, 7), (1, 9, 45, 20, 8)]
        apart = pick_first_in_file(long, place="at")
        assert minutes(apart) == [(1, 9, 30, 0, 1), (1, 9, 45, 10, 7), (1, 9, 45, 20, 8)]
        if not shuffled:
            assert shuffles(pick_first_in_file(long_histogram(hist, extra=("at",)), place="at")) == 1


def test_place_in_parquet_files(spark, tmp_path):
    rows = [hue_row(2016, 1, 9, 0, 4, minute=m) for m in (50, 10, 30)]
    histogram(spark, rows).coalesce(1).write.parquet(str(tmp_path / "h"))
    hist = hs.read_histograms(spark, str(tmp_path / "h"), place="at")
    first = pick_first_in_file(long_histogram(hist, extra=("at",)), place="at")
    assert [r.Minute for r in first.collect()] == [50]
