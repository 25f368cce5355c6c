"""Whole queries: sessions over a folder of reads, and the catalogue of named queries."""
