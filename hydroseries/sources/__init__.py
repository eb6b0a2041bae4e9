"""Readers and writers for landed files. Fetching over a network is not part of the library."""
