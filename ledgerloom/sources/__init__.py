"""Readers: contract CSV files, register XML, seeds, the calendar, parquet tables."""
