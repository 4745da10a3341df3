"""Structured Streaming: the moderation transform on a stream."""
