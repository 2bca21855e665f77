"""The query language: lexer, parser and compiler to DataFrame plans."""
