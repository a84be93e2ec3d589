"""Structured Streaming forms of discovery, embedding and progress. Beyond the batch operators they wrap."""
