from postlode.operators.reports import CSV_COLUMNS
from postlode.operators.sinks import write_csv
from postlode.schema import conform


def lines(folder):
    return [x for f in sorted(folder.glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]


def test_csv_best_first_and_head_of_empty_table(spark, tmp_path):
    rows = conform(spark.createDataFrame([("a", 1, 0), ('b, "c"', 9, 1)], "job_title string, relevance_score int, _seq long"), "_seq")
    write_csv(rows, str(tmp_path / "x"))
    got = lines(tmp_path / "x")
    assert len(CSV_COLUMNS) == 29
    body = [x for x in got if not x.startswith("relevance_score")]
    assert body[0].startswith("9,") and '"b, ""c"""' in body[0] and body[1].startswith("1,")
    write_csv(rows.filter("false"), str(tmp_path / "y"))
    assert lines(tmp_path / "y") == [",".join(CSV_COLUMNS)]
