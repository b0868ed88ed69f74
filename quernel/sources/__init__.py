from quernel.sources.parquet import ParquetSource, read_table, register_tables

__all__ = ["ParquetSource", "read_table", "register_tables"]
