"""Column functions: text normalisation, phonetic forms and fuzzy string scores."""
