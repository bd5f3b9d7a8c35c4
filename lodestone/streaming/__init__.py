"""Streams: index maintenance, rate limits, the circuit breaker and the conversation store."""
