"""Readers and writers of the file formats: whole texts, line files, JSON, PDF headers, HTML catalogs."""
