"""The change log and imports as Structured Streaming jobs."""
