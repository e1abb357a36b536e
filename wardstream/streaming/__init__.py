"""The stateless transforms on streams, and stateful deduplication."""
