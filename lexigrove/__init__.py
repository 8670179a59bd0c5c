"""A text-index engine on PySpark: S-prefixes, suffix arrays and generalized suffix trees as DataFrames."""
