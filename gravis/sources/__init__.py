"""Readers and writers: driver tables, case views, delimited extracts, result sinks."""
