"""Readers, parsers, generator, and stores."""
