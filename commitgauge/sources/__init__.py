"""Readers and writers for the tables this library works on."""
