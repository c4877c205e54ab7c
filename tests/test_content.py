"""Detection by content: signatures with masks and offsets, containers, the look of text, wrong names."""

import io
import zipfile

from pyspark.sql import functions as F

from folium.functions.content import detect_by_content
from folium.operators.convert import convert


def archive(*entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries:
            z.writestr(name, body)
    return out.getvalue()


CASES = [
    ("a.txt", b"%PDF-1.4 x", "application/pdf", None), ("a.pdf", b"no pdf", "text/plain", None), ("a.pdf", b"", "application/pdf", "pdf"), ("none", b"", None, None), ("a.gif", b"GIF87a..", "image/gif", None),
    ("a", b"GIF89a..", "image/gif", None), ("a", b"GIF88a..", "text/plain", None), ("a.md", b"RIFF\x10\x00\x00\x00WEBPVP8 ", "image/webp", None), ("a", b"RIFF\x10\x00\x00\x00WAVE", "application/octet-stream", None),
    ("a.tgz", b"x" * 257 + b"ustar\x00", "application/x-tar", None), ("a.docx", archive(("x", "y")), "application/zip", None), ("a.zip", archive(("b/1", "x" * 9000), ("word/document.xml", "<a/>")), "application/vnd.openxmlformats-officedocument.wordprocessingml.document", None),
    ("a.zip", archive(("mimetype", "application/epub+zip"), ("xl/workbook.xml", "")), "application/epub+zip", None), ("a.zip", archive(), "application/zip", None), ("a.zip", b"PK\x03\x04", "application/zip", None),
    ("a.csv", b"\xef\xbb\xbf  <!-- c --> <html>", "text/html", None), ("a.HTM", b"<h1>x", "text/html", "htm"), ("a.txt", b"<?xml version='1.0'?><!DOCTYPE html PUBLIC 'x'>\n<html>", "application/xhtml+xml", None), ("a.xml", b"<root a='1'>", "application/xml", "xml"),
    ("a.xml", b"<p>text", "text/html", None), ("a.txt", b"1 < 2 and <3", "text/plain", "txt"), ("a.log", b' {"a": 1}\n', "application/json", None), ("a.json", b'{"a": 1', "text/plain", None), ("a.md", b"[link](x)", "text/markdown", "md"), ("a", b"[1, 2]", "application/json", None),
    ("a.csv", b"\x00\x01\x02", "text/csv", "csv"), ("a.bin", b"\x00\x01", "application/octet-stream", None), ("a.txt", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage", None), ("dir\\b.MD", "é".encode(), "text/markdown", "md"), ("a.txt", None, "text/plain", "txt"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _, _) in enumerate(CASES)], "id int, path string, content binary")
    got = {r["id"]: r["d"] for r in df.select("id", detect_by_content(F.col("path"), F.col("content")).alias("d")).collect()}
    for i, (path, _, mime, ext) in enumerate(CASES):
        assert (got[i]["mimetype"], got[i]["extension"]) == (mime, ext), CASES[i]
    assert got[len(CASES) - 2]["filename"] == "b.MD"


def test_as_the_detector_of_convert(spark):
    rows = [("page.csv", b"<html><body><h1>T</h1><p>x</p>"), ("data.txt", b'{"a":[1]}'), ("notes.html", b"plain * text"), ("x.pdf", b"%PDF-1.4")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: (r["converter"], r["markdown"]) for r in convert(df, detector=detect_by_content).collect()}
    assert got == {"page.csv": ("html", "# T\n\nx"), "data.txt": ("json", '```json\n{\n    "a": [\n        1\n    ]\n}\n```'), "notes.html": ("text", "plain * text"), "x.pdf": (None, None)}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", b"x")], "path string, content binary")
    plan = df.select(detect_by_content(df["path"], df["content"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
