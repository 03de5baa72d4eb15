"""State over time: job logs, checkpoints, caches with expiry, rate limits; as batches and as streams."""
