"""Readers and writers: review lines, delimited files, review pages, sinks, asset audits."""
