"""Sources and sinks: layer stores, derived test layers, WKT ingest."""
