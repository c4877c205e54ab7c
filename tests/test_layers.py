"""Parsers know no renderer, and nothing outside the training-data subpackage knows it."""

import ast
from pathlib import Path

ROOT = Path(__file__).parent.parent / "folium"


def imports(path):
    for n in ast.walk(ast.parse(path.read_text())):
        if isinstance(n, ast.ImportFrom):
            yield n.module or ""
        elif isinstance(n, ast.Import):
            yield from (a.name for a in n.names)


def test_layers():
    for path in ROOT.rglob("*.py"):
        found = set(imports(path))
        if "llm" not in path.parts:
            assert not any(m.startswith("folium.llm") for m in found), path
        if "parsers" in path.parts:
            assert "folium.render" not in found, path
