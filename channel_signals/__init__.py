"""Channel authenticity analytics on Spark: features, scores, evaluation, curation."""
