"""Sequence-feature association on Spark: DataFrame in, DataFrame out."""
