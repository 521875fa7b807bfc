"""Readers, writers, shared scratch tables and the demo data set."""
