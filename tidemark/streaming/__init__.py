"""Structured Streaming: sources, keyed state, ledger and serving sinks."""
