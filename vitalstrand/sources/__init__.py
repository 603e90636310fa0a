"""Clinical tables, data bindings and sinks."""
