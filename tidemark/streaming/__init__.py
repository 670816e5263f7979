"""Structured Streaming: the replay of frozen signals over arriving bars."""
