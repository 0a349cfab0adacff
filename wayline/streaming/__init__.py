"""Route counts kept up to date by Structured Streaming."""
