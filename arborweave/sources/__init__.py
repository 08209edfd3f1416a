"""Readers and writers: edge lists and metric reports."""
