"""Readers and writers of ledger data, and the ledger views over the star-schema fixture."""
