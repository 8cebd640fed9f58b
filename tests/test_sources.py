import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.sources import archives, files, json_tables, sinks, tabular
from tidemark.streaming import ingest


def zipped(folder, day, lines, extra=()):
    p = folder / f"eod_{day}.zip"
    with zipfile.ZipFile(p, "w") as z:
        for n, t in (("a.csv", lines), *extra):
            z.writestr(n, t)
    return str(p)


def test_archives(spark, tmp_path):
    a = zipped(tmp_path, "2021-04-09", "Underlying Symbol,Bid_1545,trade_volume,odd\nA,66,10.0,x\nB,N/A,,NULL\n")
    b = zipped(tmp_path, "2021-04-12", "underlying_symbol,bid_1545\nC,zz\n")
    (tmp_path / "sub").mkdir()
    found = archives.discover(spark, str(tmp_path))
    assert found == sorted([f"file:{a}", f"file:{b}"])
    assert archives.select(found, first=date(2021, 4, 10)) == found[1:] and archives.select(found, most=1) == found[:1]
    with pytest.raises(ValueError):
        archives.archive_date("x.zip")
    rows = archives.read_zipped(spark, found)
    t = archives.typed(rows, {"underlying_symbol": "string", "bid_1545": "double", "trade_volume": "bigint"}, ["underlying_symbol"])
    assert t.columns == ["archive", "underlying_symbol", "bid_1545", "trade_volume", "odd"]
    assert sorted(tuple(r)[1:] for r in t.collect()) == [("A", 66.0, 10, "x"), ("B", None, None, None), ("C", None, None, None)]
    with pytest.raises(ValueError, match="strike"):
        archives.typed(rows, {}, ["strike"])
    two = zipped(tmp_path, "2021-04-13", "a\n1\n", [("b.csv", "a\n1\n")])
    with pytest.raises(Exception, match="2 CSV"):
        archives.read_zipped(spark, [two]).collect()


def test_tabular(spark, tmp_path):
    (tmp_path / "Readme_tnic.txt").write_text("x")
    (tmp_path / "vertnetwork_tnic.tsv").write_text("year\tgvkey1\n2015\tNA\n2016\t7\n")
    (tmp_path / "tnic3.csv").write_text("year,score\n2015,\n")
    kinds = {"vertical": ("vtnic", "vertnetwork"), "horizontal": ("tnic",)}
    found = tabular.discover_links(spark, str(tmp_path), kinds)
    assert {k: v.rsplit("/", 1)[1] for k, v in found.items()} == {"vertical": "vertnetwork_tnic.tsv", "horizontal": "tnic3.csv"}
    assert [tuple(r) for r in tabular.scan(spark, found["vertical"]).collect()] == [("2015", None), ("2016", "7")]
    (tmp_path / "tnic4.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        tabular.discover_links(spark, str(tmp_path), kinds)


def test_json(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"fields": ["cik", "name"], "data": [[1, "A"], [2, None]]}))
    assert [tuple(r) for r in json_tables.read_column_lists(spark, str(tmp_path / "c.json")).collect()] == [("1", "A"), ("2", None)]
    df = spark.createDataFrame([(1, (["a", "b"], ["x"]))], "k int, r struct<p: array<string>, q: array<string>>")
    assert [tuple(r) for r in json_tables.rows_of_arrays(df, "r", ["p", "q"], ["k"]).collect()] == [(1, "a", "x"), (1, "b", None)]


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("2020-01-01", 1), ("2020-01-02", 2)], "d string, x int")
    assert sinks.write_partitions(df, path, "d") == {"written": 2, "skipped": 0}
    more = spark.createDataFrame([("2020-01-02", 9), ("2020-01-03", 3)], "d string, x int")
    assert sinks.write_partitions(more, path, "d", sort=["x"]) == {"written": 1, "skipped": 1}
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert sinks.write_partitions(more, path, "d", overwrite=True) == {"written": 2, "skipped": 0}
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 3, 9]
    (tmp_path / "t" / "junk").mkdir()
    with pytest.raises(ValueError):
        sinks.partitions(spark, path, "d")
    with pytest.raises(FileExistsError):
        files.refuse_existing(spark, path)
    with pytest.raises(FileNotFoundError):
        files.require_existing(spark, path + "x")


def test_partitions_of_a_path_with_a_scheme(spark, tmp_path):
    path = f"file:{tmp_path / 't'}"
    df = spark.createDataFrame([(date(2020, 1, d), d) for d in (1, 2, 5)], "d date, x int")
    assert sinks.write_partitions(df, path, "d") == {"written": 3, "skipped": 0}
    again = spark.createDataFrame([(date(2020, 1, 2), 99)], "d date, x int")
    assert sinks.write_partitions(again, path, "d") == {"written": 0, "skipped": 1}
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2, 5]
    assert sinks.partition_paths(spark, path, "d", first=date(2020, 1, 2), last=date(2020, 1, 4)) == [f"{path}/d=2020-01-02"]
    assert sinks.date_bounds(spark.read.parquet(path), "d") == (date(2020, 1, 1), date(2020, 1, 5))
    assert sinks.date_bounds(df.limit(0), "d") == (None, None)


PAGE = {"cik": "1012345", "name": "Varian Inc", "filings": {"recent": {"accessionNumber": ["a-1", "a-2"], "form": ["8-K", "10-Q"], "filingDate": ["2020-01-02", "2020-02-03"], "acceptanceDateTime": ["2020-01-02T10:00:00Z", None], "items": ["1.01", ""], "primaryDocDescription": ["new", "q"]}}}


def test_submissions_hits_and_cache(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "CIK0001012345.json").write_text(json.dumps(PAGE))
    shard = {k: v[:1] for k, v in PAGE["filings"]["recent"].items()} | {"primaryDocDescription": ["old"]}
    (tmp_path / "s" / "CIK0001012345-submissions-001.json").write_text(json.dumps(shard | {"accessionNumber": ["a-1"]}))
    (tmp_path / "s" / "broken.json").write_bytes(b'{"name": "\xff')
    got = {r.accession_number: (r.cik, r.form, str(r.filing_date), r.description) for r in json_tables.read_submissions(spark, str(tmp_path / "s")).collect()}
    assert got == {"a-1": ("0001012345", "8-K", "2020-01-02", "new"), "a-2": ("0001012345", "10-Q", "2020-02-03", "q")}
    assert [r.accession_number for r in json_tables.read_submissions(spark, str(tmp_path / "s"), forms=["10-Q"], first=date(2020, 2, 1), last=date(2020, 3, 1)).collect()] == ["a-2"]
    assert json_tables.read_cached(spark, str(tmp_path / "s")).count() == 3
    hit = lambda i, adsh, names: {"_id": i, "_source": {"adsh": adsh, "ciks": ["77"], "display_names": names, "file_date": "2020-01-01"}}
    (tmp_path / "h").mkdir()
    for page, hits in ((1, [hit("x:1", "x", ["A"]), hit("y:1", "", ["B"])]), (2, [hit("x:1", "x", ["C"])])):
        (tmp_path / "h" / f"p{page}.json").write_text(json.dumps({"hits": {"hits": hits}}))
    found = {r.id: (r.accession_number, r.cik, list(r.display_names)) for r in json_tables.read_hits(spark, str(tmp_path / "h")).collect()}
    assert found == {"x:1": ("x", "0000000077", ["C"]), "y:1": ("y", "0000000077", ["B"])}


def test_seed(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("gvkey,iid,cik,first_date,last_date\n001234,01,77,2010-01-01,2012-12-31\nNA,01,5,2010-01-01,2010-01-02\n")
    assert [tuple(map(str, r)) for r in tabular.read_seed(spark, str(tmp_path / "seed.csv")).collect()] == [("1234", "01", "0000000077", "2010-01-01", "2012-12-31")]
    (tmp_path / "bad.csv").write_text("gvkey,iid,cik,first_date,last_date\n1,01,77,soon,2012-12-31\n")
    with pytest.raises(Exception):
        tabular.read_seed(spark, str(tmp_path / "bad.csv")).collect()


def test_files_and_texts(spark, tmp_path):
    files.ensure_folders(spark, str(tmp_path / "a" / "b"))
    files.write_text(spark, str(tmp_path / "a" / "t.md"), "é\n")
    assert (tmp_path / "a" / "t.md").read_text() == "é\n"
    assert files.folders(spark, str(tmp_path / "a")) == ["b"] and files.folders(spark, str(tmp_path / "none")) == []
    assert [files.number(x) for x in (None, float("nan"), 1.5)] == ["n/a", "n/a", "1.5000"] and files.percent(0.343) == "34.3%" and files.thousands(1197) == "1,197"
    assert files.markdown_report("T", [("rows", 3), ("none", None)], [("Q", "| a |\n")]) == "# T\n\n- rows: 3\n- none: n/a\n\n## Q\n\n| a |\n"


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"paths": {"raw": "in", "cache": "s3://b/c"}, "windows": {"estimation": [-60, -10]}, "case": {"source_symbol": " brk/b ", "event_date": "2020-01-02"}}))
    s = config.load(str(tmp_path / "c.json"))
    assert s.paths.raw == str(tmp_path / "in") and s.paths.cache == "s3://b/c" and s.paths.reports == str(tmp_path / "outputs" / "reports")
    assert s.windows.estimation == (-60, -10) and s.windows.announcement == (0, 1) and s.case.source_symbol == "BRK.B" and s.case.event_date == date(2020, 1, 2) and s.first_date is None
    assert config.series_id("a", "a", date(2020, 1, 17), 65, "call") == "A|A|2020-01-17|65.0|C"
    for bad in ({"x": 1}, {"windows": {"estimation": [3, 1]}}, {"paths": {"y": "z"}}):
        with pytest.raises(ValueError):
            config.from_dict(bad)
    with pytest.raises(ValueError):
        config.option_type("X")


def test_reports(spark, tmp_path):
    files.write_report(spark, str(tmp_path / "r" / "a.json"), {"b": date(2020, 1, 1), "a": 1})
    assert (tmp_path / "r" / "a.json").read_text() == '{\n  "a": 1,\n  "b": "2020-01-01"\n}\n'
    assert sinks.markdown_table([{"a": "x|y\n", "b": None}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| x\\|y  | n/a |\n"
    sinks.bundle(str(tmp_path / "b.zip"), str(tmp_path / "r"), ["a.json"], "note")
    assert zipfile.ZipFile(tmp_path / "b.zip").namelist() == ["README.md", "a.json"]


def test_incremental_ingest(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "d string, x int"
    clean = lambda b: b.where("x > 0")
    for rows in ([("a", 1), ("a", -1)], [("b", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest_new(spark, src, schema, clean, out, cp, "d").awaitTermination()
    assert sorted((r.d, r.x) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2)]


def test_stream_of_days(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "u"), ("2024-01-01 11:00:00", "u"), ("2024-01-09 10:00:00", "v")]
    df = spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = ingest.daily_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s")), "t", "k")
    q = stream.writeStream.outputMode("append").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert [(str(r.day), r.k, r.n) for r in spark.table("days").collect()] == [("2024-01-01", "u", 2)]
