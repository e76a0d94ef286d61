"""Transcript and media-corpus analytics as ordinary Spark jobs."""
