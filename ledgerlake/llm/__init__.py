"""Training-data operators: near-duplicates, language, decontamination, search, extraction, files, packing, quality, chat.

Nothing else in the library imports this subpackage; ``registry`` lists its queries and their SQL.
"""
