"""The operators run over the driver's tables, which stand in for message data."""
