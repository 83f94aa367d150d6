"""Schemas of the tables; read with these, never inferred."""

from pyspark.sql import types as T

PAPER_COLUMNS = "conference year venue paper_type title abstract TLDR keywords authors track_or_subject_areas submission_date openreview_url pdf_url openreview_id paper_number".split()
PAPER = T.StructType([T.StructField(c, T.IntegerType() if c == "year" else T.StringType()) for c in PAPER_COLUMNS])
CUBE = T.StructType([T.StructField("topic", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("venue", T.StringType()), T.StructField("count", T.LongType())])
EVALUATION = T.StructType([T.StructField("topic", T.StringType()), *[T.StructField(c, T.BooleanType()) for c in "predicted_positive exploded recency acceleration spread scale".split()]])
