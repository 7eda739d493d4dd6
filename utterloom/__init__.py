"""Utterloom: scoring, segmenting and evaluating short utterances on Spark."""
