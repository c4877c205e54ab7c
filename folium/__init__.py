"""folium: documents to Markdown on Spark, as DataFrame operators."""

__version__ = "0.1.0"
