"""Readers, parsers and writers for the formats the engine takes in and puts out."""
