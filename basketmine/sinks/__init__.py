"""Writers: text and parquet outputs of a mining run."""
