"""A versioned keyed-table engine on PySpark DataFrames."""
