"""JSON laid out in Catalyst against the parser of Python."""

import random
import time

from folium.operators.tokens import pretty_json
from folium.parsers import plain


def laid(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return [r["text"] for r in sorted(pretty_json(rows, "k", "text").collect(), key=lambda r: r["k"])]


def test_random_texts(spark):
    r = random.Random(3)
    parts = ['{', '}', '[', ']', ',', ':', '"', '\\', '\\"', '"a"', '"b, {c}"', '"\\\\"', ' ', '\n', '1', 'true', ' ', '\x85', 'é', '😀', '\uffff', '[]', '{ }']
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)]
    texts += ['{"a": [1, {"b": {}}, []], "c": "x\\n\\"y\\""}', "[1,", '"open', "", "  ", "null", '{"a":1}}', "}"]
    assert laid(spark, texts) == [plain.pretty_json(x) for x in texts]


def test_long_texts(spark):
    texts = ['["' + '\\"' * 200_000 + '"]', '"' * 1 + "\\\\" * 200_000, "[" * 300 + "]" * 300, "[" + "1," * 100_000 + "1]", ' "' * 50_001, "x" * 500_000]
    start = time.time()
    assert laid(spark, texts) == [plain.pretty_json(x) for x in texts] and time.time() - start < 60


def test_rows_and_plan(spark):
    rows = spark.createDataFrame([(None, "[1]", 1), (None, "[1]", 2), (3, None, 3)], "k long, text string, row int")
    assert sorted(map(str, (r["text"] for r in pretty_json(rows, "k", "text").collect()))) == ["", "[\n    1\n]", "[\n    1\n]"]
    assert pretty_json(rows.limit(0), "k", "text").count() == 0
    plan = pretty_json(rows, "k", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
