"""skylattice: flight-recording analytics expressed as PySpark DataFrame plans."""

from skylattice.session import build_session, load_table, shared_dir

__all__ = ["build_session", "load_table", "shared_dir"]
