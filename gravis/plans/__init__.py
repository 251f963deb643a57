"""Named analyses (Spark builders plus SQL oracles) and end-to-end jobs."""
