"""filigree: minimum-distortion embedding and the data processing round it, on Spark DataFrames."""

__version__ = "0.1.0"
