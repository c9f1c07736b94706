"""Lexer and parser of the expression language."""
