"""Readers and writers: inbox, EPUB items, ledger, converter output, result tables."""
