"""Landing scans and table sinks."""
