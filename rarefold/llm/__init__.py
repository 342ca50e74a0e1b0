"""Operators for preparing training data: ten corpus operators over Spark
DataFrames, their registered queries (``queries``) and nothing that the rest of
the package needs."""
