"""Streams of job events: leases and what they decide, and event-time summaries."""
