"""Table readers and keyed sinks."""
