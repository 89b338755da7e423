"""Time-series motion analytics as Spark DataFrame operators.

Every operator takes a DataFrame plus the names of its key columns and returns
a DataFrame.  Nothing in the package calls ``collect`` on data.
"""
