"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it. Every operator takes DataFrames and column names and returns
DataFrames; the thin queries over the standard tables are in ``folium.llm.queries``.
"""
