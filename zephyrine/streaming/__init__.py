"""Change logs and topics as streams, and windowed aggregates over event time."""
