"""End-to-end plans that chain sources, operators and sinks."""
