"""voidloom: topology and transport of particle systems on Spark DataFrames."""

__version__ = "0.1.0"
