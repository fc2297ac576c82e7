import pandas as pd
import pytest

from plumbline.operators.privacy import privacy_scan
from plumbline.sources import readers as A
from plumbline.sources.quarantine import quarantine_summary, read_with_quarantine
from plumbline.sources.sinks import write_arrow


@pytest.fixture(scope="module")
def small(spark):
    pdf = pd.DataFrame({"col1": range(100), "col2": [i / 3 for i in range(100)], "col3": ["A"] * 50 + ["B"] * 50})
    return pdf, spark.createDataFrame(pdf)


def test_formats(spark, small, tmp_path):
    pdf, df = small
    pdf.to_csv(tmp_path / "a.csv", index=False)
    pdf.to_csv(tmp_path / "a.tsv", index=False, sep="\t")
    pdf.to_json(tmp_path / "a.json", orient="records")
    pdf.to_json(tmp_path / "a.jsonl", orient="records", lines=True)
    pdf.to_parquet(tmp_path / "a.PARQUET")
    pdf.to_feather(tmp_path / "a.feather")
    for name in ("a.csv", "a.tsv", "a.json", "a.jsonl", "a.PARQUET", "a.feather"):
        got = A.read_dataset(spark, str(tmp_path / name)).select("col1", "col2", "col3").toPandas().sort_values("col1")
        assert got["col1"].tolist() == pdf["col1"].tolist(), name
        assert got["col3"].tolist() == pdf["col3"].tolist(), name


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        A.read_dataset(spark, "data.xyz")


def test_arrow_batches_become_partitions(spark, small, tmp_path):
    _, df = small
    out = str(tmp_path / "arrow")
    written = write_arrow(df.repartition(4), out).collect()
    back = A.read_dataset(spark, out, "arrow")
    assert back.count() == 100 == sum(r["rows"] for r in written)
    assert back.rdd.getNumPartitions() == 4
    assert back.select("col3").distinct().count() == 2


def test_malformed_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\n1,2\nx,3\n4,5\n")
    kept = A.read_dataset(spark, str(tmp_path / "m.csv"), schema="a int, b int", drop_malformed=True)
    assert sorted(r["a"] for r in kept.collect()) == [1, 4]


def test_metadata(spark, small, tmp_path):
    pdf, _ = small
    pdf.to_csv(tmp_path / "m.csv", index=False)
    row = A.dataset_metadata(spark, str(tmp_path / "m.csv")).head()
    assert (row["format"], row["row_count"], row["column_count"]) == ("csv", 100, 3)
    assert row["size_bytes"] == (tmp_path / "m.csv").stat().st_size


def test_bad_rows_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,x\n1,"a, b",2.5\n2,b\nthree,c,1\n4,d,1,9\n5,,\n')
    good, bad = read_with_quarantine(spark, str(tmp_path / "a.csv"), "id int, name string, x double", str(tmp_path / "q1"))
    assert sorted(map(tuple, good.collect())) == [(1, "a, b", 2.5), (5, None, None)]
    assert sorted(r["raw"] for r in bad.collect()) == ["2,b", "4,d,1,9", "three,c,1"] and bad.filter("source_file LIKE '%a.csv'").count() == 3
    assert sorted(r["id"] for r in good.select("id").collect()) == [1, 5]  # the same rows are good when few columns are read
    assert quarantine_summary(good, bad).head().asDict() == {"good_rows": 2, "bad_rows": 3, "bad_pct": 60.0}
    (tmp_path / "b.jsonl").write_text('{"id": 1, "m": {"k": 2}}\n{"id": "x", "m": {}}\nnot json\n{"id": 3}\n\n')
    good, bad = read_with_quarantine(spark, str(tmp_path / "b.jsonl"), "id int, m map<string,int>", str(tmp_path / "q2"))
    assert sorted(r["id"] for r in good.collect()) == [1, 3] and bad.count() == 2
    (tmp_path / "c.tsv").write_text("id\tname\n")
    good, bad = read_with_quarantine(spark, str(tmp_path / "c.tsv"), "id int, name string", str(tmp_path / "q3"))
    assert (good.count(), bad.count(), quarantine_summary(good, bad).head()["bad_pct"]) == (0, 0, 0.0)
    with pytest.raises(ValueError):
        read_with_quarantine(spark, "x.parquet", "id int", str(tmp_path / "q4"))


def test_privacy_scan(spark):
    rows = [("a.b@c.org, d@e.com; 078-05-1120 000-12-3456 123-45-6789-0", None), ("card 4111 1111 1111 1111 or 4111111111111112", "+1 (806) 555-0902 806.555.0902"), (None, ""), ("é4111111111111111é", "x" * 300_000)]
    got = {r["col"]: r.asDict() for r in privacy_scan(spark.createDataFrame(rows, "t string, u string")).collect()}
    assert got["t"] == {"col": "t", "rows": 4, "emails": 2, "phones": 0, "ssns": 1, "cards": 2, "flagged_rows": 3, "has_pii": True}
    assert got["u"] == {"col": "u", "rows": 4, "emails": 0, "phones": 2, "ssns": 0, "cards": 0, "flagged_rows": 1, "has_pii": True}
    long = ["a." * 400_000, "a@" * 400_000, "1-" * 400_000, "9" * 800_000, "-" * 800_000, "(" * 800_000, "1 " * 400_000, "q@" + "a." * 400_000]
    assert privacy_scan(spark.createDataFrame([(t,) for t in long], "t string")).head()["rows"] == len(long)
    assert privacy_scan(spark.createDataFrame([], "t string")).collect() == []
