"""Relational and stateful operators over records, events and ledgers."""
