"""Structured Streaming forms of the cart, booking and account jobs."""
