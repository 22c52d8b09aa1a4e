"""Analytics over periodic stock snapshots, as lazy PySpark DataFrames."""

from periodica.spec import DEFAULT_SPEC, SnapshotSpec

__all__ = ["DEFAULT_SPEC", "SnapshotSpec"]
