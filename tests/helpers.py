"""Small hand-written histogram tables."""

from huestrata.schema import HISTOGRAM_SCHEMA


def hue_row(year, day, hour, bin_, size, *, minute=0, camera="c1", dataset="d", pixels=100, **attrs):
    return {
        "Dataset": dataset, "Camera_ID": camera, "Year": year, "Day": day, "Hour": hour,
        "Minute": minute, "Metric_Type": "HSV", "Considered_Pixels": pixels,
        "HSV_Bin": bin_, "HSV_H": None if size is None else float(size), "Gcc_Bin": -1, **attrs,
    }


def green_row(year, day, hour, bin_, size, *, minute=0, camera="c1", dataset="d", **attrs):
    return {
        "Dataset": dataset, "Camera_ID": camera, "Year": year, "Day": day, "Hour": hour,
        "Minute": minute, "Metric_Type": "Gcc", "Considered_Pixels": 100,
        "HSV_Bin": -1, "Gcc_Bin": bin_, "Gcc_Value": None if size is None else float(size), **attrs,
    }


def histogram(spark, rows):
    names = [f.name for f in HISTOGRAM_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], HISTOGRAM_SCHEMA)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
