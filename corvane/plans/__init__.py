"""Lexer, parser, name resolution and lowering to DataFrames."""
