"""bitweave: similarity analytics, binary codes, graphs and clause models on Spark DataFrames."""

__version__ = "0.1.0"
