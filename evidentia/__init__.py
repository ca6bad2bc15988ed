"""Attachment-evidence analytics on Spark: observations, rules, scores and reports as DataFrames."""
