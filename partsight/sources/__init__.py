"""Readers and writers: driver tables, derived domain tables, page files, note trees, catalogues."""
