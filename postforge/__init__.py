"""Posting intelligence on Spark: clean, classify, match, merge, score, rank and report records of job postings."""
