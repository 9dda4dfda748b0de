"""Readers and writers: query logs, tables, schema catalogues, result folders."""
