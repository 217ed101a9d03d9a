"""cohortlab: cohort-study operators on Spark DataFrames.

Sub-packages: ``sources`` (readers/sinks), ``functions`` (column
expressions, tail probabilities), ``operators`` (DataFrame -> DataFrame
operators), ``plans`` (fixture views and the registered queries),
``streaming`` (the same sufficient statistics over a file stream).
"""

__version__ = "0.1.0"
