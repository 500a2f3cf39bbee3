"""Coderill: bytecode forensics at scale on Spark DataFrames."""
