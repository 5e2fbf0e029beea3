"""Feature engineering and tabular regression on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames (or Columns). Nothing
runs until a sink, a fitted dictionary or a model asks for it.
"""
