"""Readers and writers of delimited, interval, sequence and report text."""
