"""Scans: raw messages, label listings, responses and captured logs."""
