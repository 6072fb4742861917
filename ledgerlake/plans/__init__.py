"""The library's queries over a folder of tables, and the same questions in SQL."""
