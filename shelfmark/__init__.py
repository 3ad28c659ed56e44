"""shelfmark: DataFrame operators and batch jobs for analysing large item catalogues on Spark.

Operators take DataFrames and column names and give back lazy DataFrames; see README.md.
"""

__version__ = "0.1.0"
