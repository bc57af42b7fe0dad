"""Formats as column functions, file sources and sinks, and generators; transports stay apart from codecs."""
