"""Spark-native data processing for rubric-based judging: scoring, pairing, metrics, prompts, negatives, sampling, curation."""
