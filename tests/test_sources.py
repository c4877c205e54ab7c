"""Sources and sinks of files: CSV in ranges, ZIP entries, one file a document; and rules over the element table."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folium.operators import elements
from folium.parsers.html_tree import Element, parse
from folium.parsers.html_walk import DROPPED, Walker, nearest_table, prune
from folium.parsers.plain import csv_records
from folium.sources import csv, datasources

RANGES = {"spark.sql.files.maxPartitionBytes": "96", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}


def records(spark, path, monkeypatch=None):
    """All records in order; the source is read in short ranges, what is written in between is not."""
    if monkeypatch:
        write = csv.written

        def short(df, name):
            if name != "csv-lines":
                return write(df, name)
            for k, v in RANGES.items():
                spark.conf.set(k, v)
            try:
                assert df.rdd.getNumPartitions() > 20
                return write(df.coalesce(3), name)
            finally:
                for k in RANGES:
                    spark.conf.unset(k)

        monkeypatch.setattr(csv, "written", short)
    rows = csv.read_csv(spark, str(path)).orderBy("path", "block", "line", "part").collect()
    return [(r["path"].rpartition("/")[2], r["cells"]) for r in rows]


def test_csv_in_ranges(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    pieces = ["a", "b,", '"', '""', "\n", "\r\n", "\r", " ", "é", 'x"y', ",", '"q, z"\n', "\n\n", "\t", '"two\nlines",', "long words here "]
    want = []
    for f in range(14):
        source = "".join(r.choice(pieces) for _ in range(r.randrange(0, 160)))
        (tmp_path / f"{f:02d}.csv").write_bytes(source.encode())
        want += [(f"{f:02d}.csv", x) for x in csv_records(source)]
    assert records(spark, tmp_path, monkeypatch) == want


def test_csv_odd_files(spark, tmp_path):
    sources = {"a.csv": "", "b.csv": '"', "c.csv": "\n\r\n \n", "d.csv": 'x,"never closed, ' + "word " * 60 + "\n\nend  ", "e.csv": "a," * 200 + "z", "f.csv": 'a, z "', "g.csv": 'z""", \n', "h.csv": '""\n"' + 'q""' * 90 + '"\n'}
    for name, source in sources.items():
        (tmp_path / name).write_bytes(source.encode())
    assert records(spark, tmp_path) == [(n, x) for n, s in sources.items() for x in csv_records(s)]


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body, method in entries:
            z.writestr(name, body, method)
    return out.getvalue()


def test_zip_entries(spark, tmp_path):
    bodies = {f"d/{i}.{'html' if i % 3 else 'txt'}": (f"body {i} é " * (i * 40)).encode() for i in range(60)}
    whole = archive([(n, b, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED) for i, (n, b) in enumerate(bodies.items())] + [("d/", b"", zipfile.ZIP_STORED), ("7z", b"x" * 99, zipfile.ZIP_BZIP2)])
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.zip").write_bytes(whole)
    (tmp_path / "none.zip").write_bytes(b"")
    (tmp_path / "text.zip").write_bytes(b"no archive at all")
    (tmp_path / "a.txt").write_bytes(whole)
    broken = bytearray(archive([("one", b"word " * 500, zipfile.ZIP_DEFLATED), ("two", b"2", zipfile.ZIP_STORED)]))
    broken[40] ^= 0xFF
    broken[41] ^= 0xFF
    (tmp_path / "broken.zip").write_bytes(bytes(broken))
    df = datasources.read_zip(spark, str(tmp_path), range_bytes=700)
    assert df.rdd.getNumPartitions() > 20
    got = {(r["path"].rpartition("/")[2], r["name"]): r["content"] for r in df.collect()}
    assert got == {("a.zip", n): b for n, b in bodies.items()} | {("a.zip", "7z"): None, ("broken.zip", "one"): None, ("broken.zip", "two"): b"2"}
    html = datasources.read_zip(spark, str(tmp_path / "deep" / "a.zip"), names="d/*.html").collect()
    assert {r["name"]: bytes(r["content"]) for r in html} == {n: b for n, b in bodies.items() if n.endswith("html")}
    assert all(r["size"] == len(r["content"]) for r in html)
    assert datasources.read_zip(spark, str(tmp_path / "deep"), suffix=".none").count() == 0


def test_files_round_trip(spark, tmp_path):
    rows = [("file:/in/a b.html", "é\n"), ("_hidden", ""), (".dot", "x"), ("x" * 400, "long"), ("x" * 399 + "y", "long too"), (None, "n"), ("none", None), ("ü/漢?*", "u")]
    df = spark.createDataFrame(rows, "path string, content string").withColumn("more", F.lit(1)).repartition(4)
    datasources.write_files(df, str(tmp_path / "out"), ".md")
    got = {f.name: f.read_text() for f in (tmp_path / "out").iterdir()}
    assert got == {datasources.file_name(p, ".md"): c for p, c in rows if p is not None and c is not None} and len(got) == 6
    assert max(map(len, got)) <= datasources.LONGEST and not any(n[0] in "._" for n in got)
    datasources.write_files(df.limit(0), str(tmp_path / "out"), ".md", mode="overwrite")
    assert list((tmp_path / "out").iterdir()) == []


def test_failed_tasks_leave_nothing(spark, tmp_path):
    df = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("fails"))).otherwise("c").alias("content"))
    with pytest.raises(Exception, match="fails"):
        datasources.write_files(df, str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []
    # an attempt that fails half way and is run again: only the second one's files are moved
    writer = datasources.FileWriter({"path": str(tmp_path / "out")}, df.select("path", "content").schema, False)

    def breaks():
        yield "a", "half"
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    again = writer.write(iter([("a", "whole"), ("b", "whole")]))
    writer.commit([again, None])
    assert {f.name: f.read_text() for f in (tmp_path / "out").iterdir()} == {"a": "whole", "b": "whole"}


def by_walk(source):
    """(dropped elements, {(body rows, header)} of each table with cells) by walking the tree."""
    inside = 0
    stack = [(c, False) for c in parse(source).root.children]
    while stack:
        e, gone = stack.pop()
        if isinstance(e, Element) and e.tag != "#comment":
            gone = gone or e.tag in DROPPED
            inside += gone
            stack += [(c, gone) for c in e.children]
    tree = parse(source)
    prune(tree.root)
    made = [Walker().table(t) for t in tree.root.find_all({"table"})]
    assert all(nearest_table(t) is not t for t in tree.root.find_all({"table"}))
    return inside, sorted((len(m[0]["rows"]), bool(m[0]["header"])) for m in made if m)


def test_element_rules(spark):
    r = random.Random(4)
    parts = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "<th>", "</td>", "<div>", "</div>", "<form>", "</form>", "<script>x<table></script>", "<svg>", "</svg>", "<ul><li>", "text", "<caption>c", "<tbody>", "<p>", "<b>", "</b>", "<!-- c -->"]
    pages = [(i, "".join(r.choice(parts) for _ in range(r.randrange(60)))) for i in range(300)]
    pages += [(900, "<table><tr><td><table><tr><td>" * 40), (901, ""), (902, None), (903, "<table><tr></tr><tr><th>h</th></tr></table><table><tr><th>a<td>b</table>")]
    table = elements.element_table(spark.createDataFrame(pages, "page long, html string").repartition(3), "page").cache()
    marked = elements.marked(table, "page")
    assert marked.count() == table.count()
    dropped = {r["page"]: r["n"] for r in marked.groupBy("page").agg(F.sum(F.col("dropped").cast("int")).alias("n")).collect()}
    own = {}
    for row in elements.table_rows(table, "page").collect():
        own.setdefault(row["page"], []).append((row["body_rows"], row["has_header"]))
    for page, source in pages:
        inside, tables = by_walk(source or "")
        assert (dropped.get(page, 0), sorted(own.get(page, []))) == (inside, tables), source


def test_one_shuffle_by_document(spark):
    table = spark.createDataFrame([(1, 0, -1, 0, 0, "table")], "page long, element_id int, parent_id int, last_id int, depth int, tag string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = elements.table_rows(table, "page")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange") == 1 and "Python" not in plan
