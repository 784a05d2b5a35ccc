"""Reading and writing tables (Parquet, CSV), and generated time axes."""

from .scratch import Scratch, shared_dir
from .tables import Stages, cache_or_compute, date_axis, fingerprint_of, output_dir, path_exists, publish, published, read_csv, with_timestamp, write_csv, write_parquet

__all__ = ["Scratch", "Stages", "shared_dir", "cache_or_compute", "date_axis", "fingerprint_of", "output_dir", "path_exists", "publish", "published", "read_csv", "with_timestamp", "write_csv", "write_parquet"]
