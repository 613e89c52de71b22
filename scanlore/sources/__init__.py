"""Readers and writers: image headers, archives and databanks."""
