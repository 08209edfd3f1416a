"""Relational operators over edge tables and encoded rows."""
