"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; ``queries`` registers one thin query each.
"""
