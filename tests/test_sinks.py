"""Writing the tracker export and captured responses."""

import csv
import glob
import json

from pyspark.sql import functions as F

from tallyhire.sources.ingest import read_captured
from tallyhire.sources.sinks import TRACKER_COLUMNS, write_tracker_csv


def test_tracker_csv_doubles_quotes(spark, tmp_path):
    row = {c: None for c in TRACKER_COLUMNS} | {"company": 'Say "hi", Ltd', "title": "a\\b", "days_since": "3", "note": "x,y"}
    df = spark.createDataFrame([tuple(row[c] for c in TRACKER_COLUMNS)], ", ".join(f"{c} string" for c in TRACKER_COLUMNS))
    write_tracker_csv(df, f"{tmp_path}/out")
    lines = [r for p in glob.glob(f"{tmp_path}/out/*.csv") for r in csv.DictReader(open(p, newline=""))]
    assert [(r["company"], r["title"], r["note"], r["location"]) for r in lines] == [('Say "hi", Ltd', "a\\b", "x,y", "")]


def test_captured_responses_read_with_a_fixed_schema(spark, tmp_path):
    path = tmp_path / "captured.json"
    path.write_text(json.dumps({"seq": 1, "board_token": "t", "body": json.dumps({"jobs": []}), "extra": 1}) + "\n")
    row = read_captured(spark, str(path)).select("seq", "body", F.col("http_status").isNull().alias("no_status")).first()
    assert (row["seq"], row["body"], row["no_status"]) == (1, '{"jobs": []}', True)
