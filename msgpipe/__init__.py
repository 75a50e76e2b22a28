"""msgpipe: turn large message collections into structured summary records on Spark."""
