"""Readers for the evidence tables and documents."""
