"""Readers and writers for the tables and feeds the jobs work on."""
