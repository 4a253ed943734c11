"""Sources of events: tables, decoders of HTTP payloads, transports."""
