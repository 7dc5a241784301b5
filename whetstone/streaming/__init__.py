"""Structured Streaming jobs: rates, latency quantiles, limits, cached answers, feedback, timings, ingest."""
