import json
import zipfile
from xml.etree import ElementTree

import pytest

from gneiss import cli
from gneiss.operators.profile import profile_table
from gneiss.options import ProfileOptions
from gneiss.plans.run import generate_reports, run
from gneiss.sinks import store
from gneiss.sources import table_list
from gneiss.sources.tables import JdbcSource, TableRef, lob_stats, safe_name, scan_sql

from . import fixtures as fx


def refs(found):
    return [r.display for r in found]


def test_scan_sql():
    assert scan_sql("APP", "CUSTOMER") == "SELECT * FROM APP.CUSTOMER" and scan_sql("", "T$1#") == "SELECT * FROM T$1#"
    for bad in (("APP", "CUSTOMER;DROP TABLE X"), ("A.B", "T"), ("", ""), (None, "a b")):
        with pytest.raises(ValueError):
            safe_name(*bad)


def test_table_list(tmp_path):
    lines = ["﻿# comment", "CUSTOMER", " TEST.ORDERS ", "", "customer", "OTHER.AUDIT_LOG"]
    path = tmp_path / "tables.txt"
    path.write_text("\n".join(lines), encoding="utf-8")
    assert refs(table_list.read_file(str(path), "TEST")) == ["TEST.CUSTOMER", "TEST.ORDERS", "OTHER.AUDIT_LOG"]
    assert refs(table_list.parse_lines(["A.B"], "-")) == ["A.B"]
    for bad, schema in ((["CUSTOMER"], "-"), ([], "S"), (["# x"], "S"), (["A.B.C"], "S"), ([".B"], "S"), (["A."], "S")):
        with pytest.raises(ValueError):
            table_list.parse_lines(bad, schema)
    with pytest.raises(ValueError, match="line 2"):
        table_list.parse_lines(["A.B", "C"], None)
    assert refs(table_list.parse_commas("a, ,b,S.c", "X")) == ["X.a", "X.b", "S.c"] and refs(table_list.parse_commas("a", "-")) == ["a"]


def test_jdbc_options():
    o = JdbcSource("jdbc:x", "D", "u", "p").options(TableRef("S", "T"), ProfileOptions(query_timeout_seconds=5, clob_preview_chars=9), ["ID", "NOTE"], {"NOTE": "CLOB"})
    assert o["dbtable"] == "(SELECT ID, LENGTH(NOTE) AS NOTE, SUBSTR(NOTE, 1, 9) AS NOTE_PREVIEW FROM S.T) t" and (o["fetchsize"], o["queryTimeout"]) == ("10000", "5")
    assert "queryTimeout" not in JdbcSource("jdbc:x").options(TableRef("", "T"), ProfileOptions())


def test_lob_stats(spark):
    df = spark.createDataFrame([("abc", b"xy"), (None, None)], "t string, b binary")
    assert [tuple(r) for r in lob_stats(df, "t", preview=2).collect()] == [("CLOB", 3, "ab"), ("CLOB", None, None)]
    assert tuple(lob_stats(df, "b", binary=True).first()) == ("BLOB", 2, None)


@pytest.fixture(scope="module")
def run_dir(spark, tmp_path_factory):
    def reader(s, ref):
        if ref.table == "BROKEN":
            raise RuntimeError("x" * 2000)
        rows, schema = (fx.customers(), fx.CUSTOMER) if ref.table == "CUSTOMER" else (fx.orders(), fx.ORDERS)
        return s.createDataFrame(list(rows), schema)

    tables = [TableRef("TEST", t) for t in ("CUSTOMER", "BROKEN", "ORDERS", "BAD;NAME")]
    return run(spark, "db<1>", tables, str(tmp_path_factory.mktemp("runs")), reader=reader, lobs=lambda r: fx.LOBS if r.table == "CUSTOMER" else {})


def test_run_records(run_dir):
    s = store.RunStore(run_dir)
    m = s.read_manifest()
    assert (m["status"], m["totalTables"], m["successTables"], m["failedTables"]) == ("COMPLETED_WITH_ERRORS", 4, 2, 2)
    assert len(m["tables"][1]["errorMessage"]) == 1000 and m["options"]["fetchSize"] == 10_000 and "password" not in json.dumps(m)
    assert [r["table"] for r in s.read_tables()] == ["CUSTOMER", "ORDERS"]
    c = s.read_table("TEST", "CUSTOMER")["columns"]
    assert c[1]["name"] == "status" and c[1]["distinctCount"] == 5 and "minValue" not in c[1] and "fingerprint" not in c[1] and c[1]["values"][0] == {"value": "ACTIVE", "count": 119, "ratio": 0.595}


def test_reports(run_dir):
    generate_reports(run_dir)
    with zipfile.ZipFile(f"{run_dir}/quality-profile.xlsx") as z:
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
        sheets = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3)]
        book = z.read("xl/workbook.xml").decode()
    assert all(s in book for s in ("扫描概览", "字段质量明细", "探查提示"))
    header = ElementTree.fromstring(sheets[1]).find(".//{*}row")
    assert len(header) == 17 and "ACTIVE(119, 59.50%)" in sheets[1] and "候选唯一键" in sheets[2]
    index = open(f"{run_dir}/quality-profile.html", encoding="utf-8").read()
    page = open(f"{run_dir}/quality-profile-tables/TEST.CUSTOMER.html", encoding="utf-8").read()
    assert "db&lt;1&gt;" in index and "optional_code" not in index and "optional_code" in page and "LOB仅画像长度" in page


def test_all_failed(spark, tmp_path):
    def reader(s, ref):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="down"):
        run(spark, "db", [TableRef("", "T")], str(tmp_path), reader=reader)
    (d,) = tmp_path.iterdir()
    assert store.RunStore(str(d)).read_manifest()["status"] == "COMPLETED_WITH_ERRORS" and (d / "quality-profile.xlsx").exists()


def test_file_names(tmp_path):
    assert store.file_name("", "A$B") == "DEFAULT.A_B.json" and store.file_name("S", None) == "S.UNKNOWN.json"
    s = store.RunStore(str(tmp_path))
    paths = {s.write_table({"schema": "S", "table": t, "columns": []}) for t in ("A$B", "A#B", "A$B")}
    assert len(paths) == 2


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["a", "b"]) == 2
    spark.createDataFrame(list(fx.orders()), fx.ORDERS).write.parquet(str(tmp_path / "ORDERS.parquet"))
    assert cli.main(["files", str(tmp_path), "", "", "-", "ORDERS"]) == 0
    assert "[order_status] VARCHAR" in capsys.readouterr().out
    assert cli.main(["files", str(tmp_path), "", "", "db", "-", "ORDERS", str(tmp_path / "out")]) == 0
    (tmp_path / "list.txt").write_text("S.ORDERS\n")
    assert cli.main(["files", str(tmp_path), "", "", "db", "-", "--table-file", str(tmp_path / "list.txt"), str(tmp_path / "out2"), "500"]) == 0
    assert "quality-profile.html" in capsys.readouterr().out


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_jdbc_reads_lobs_by_length(spark, tmp_path, capsys):
    """Against the database that Spark's own jars hold."""
    url = "jdbc:derby:memory:lobs;create=true"
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    run_sql = connection.createStatement().execute
    run_sql("CREATE TABLE NOTES (ID INT NOT NULL PRIMARY KEY, NAME VARCHAR(20), NOTE CLOB, BODY BLOB)")
    for i in range(6):
        run_sql(f"INSERT INTO NOTES VALUES ({i}, 'n{i % 2}', {'NULL' if i == 5 else repr('ab12' * (i + 1))}, CAST(X'{'00' * (i + 1)}' AS BLOB))")
    source, ref = JdbcSource(url, DERBY), TableRef("APP", "NOTES")
    assert source.column_types(spark, ref) == {"ID": 4, "NAME": 12, "NOTE": 2005, "BODY": 2004} and source.primary_keys(spark, ref) == ("ID",)
    options = ProfileOptions(pattern_profile_enabled=True, clob_preview_chars=3)
    df = source.read(spark, ref, options)
    assert df.columns == ["ID", "NAME", "NOTE", "NOTE_PREVIEW", "BODY"]
    r = {x["name"]: x for x in profile_table(df, options, source.primary_keys(spark, ref)).collect()}
    assert list(r) == ["ID", "NAME", "NOTE", "BODY"] and r["ID"]["declared_primary_key"] and r["ID"]["max_value"] == "5"
    assert (r["NOTE"]["family"], r["NOTE"]["min_length"], r["NOTE"]["max_length"], r["NOTE"]["null_count"], r["NOTE"]["lob_content_skipped"]) == ("LOB", 4, 20, 1, True)
    assert [(p["pattern"], p["count"]) for p in r["NOTE"]["patterns"]] == [("L2D1", 5)]
    assert (r["BODY"]["database_type_name"], r["BODY"]["max_length"], r["BODY"]["distinct_count"]) == ("BLOB", 6, 0)
    assert JdbcSource(url, "no.such.Driver").primary_keys(spark, ref) == ()
    assert cli.main([DERBY, url, "", "", "db", "APP", "NOTES", str(tmp_path)]) == 0
    (d,) = tmp_path.iterdir()
    note = store.RunStore(str(d)).read_table("APP", "NOTES")["columns"][2]
    assert note["family"] == "LOB" and note["lobContentSkipped"] and note["maxLength"] == 20
    connection.close()


def test_tables_with_like_names_have_pages(spark, tmp_path):
    def reader(s, ref):
        return s.createDataFrame([(1,)] * len(ref.table.split("$")), "v int")

    d = run(spark, "db", [TableRef("S", "A$B"), TableRef("S", "A#B")], str(tmp_path), reader=reader)
    s = store.RunStore(d)
    assert [s.read_table("S", t)["rowCount"] for t in ("A$B", "A#B")] == [2, 1]
    pages = list((tmp_path / d / "quality-profile-tables").glob("*.html"))
    index = open(f"{d}/quality-profile.html", encoding="utf-8").read()
    assert len(pages) == 2 and all(p.name in index for p in pages)
