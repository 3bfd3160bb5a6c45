"""lexiloom: text correction, note indexing and note search over Spark DataFrames."""

__version__ = "0.1.0"
