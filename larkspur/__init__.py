"""Larkspur: Spark jobs for document, retrieval and request-telemetry workloads.

Every operator takes DataFrames and returns a DataFrame.  Plans are declared
with the DataFrame/SQL API; Arrow-batched Python is used only where an
expression cannot state the step (recursive splitting, dense top-k, LCS).
"""

__version__ = "0.1.0"
