"""Spell-check jobs over large tables of text and source code."""
