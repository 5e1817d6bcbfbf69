"""cataloom: a file catalog kept in step with storage, run as Spark jobs.

Every operation works on whole tables of requests or paths: the catalog is a
DataFrame, the files on disk are an inventory DataFrame, and each mutation
reads one catalog snapshot and yields the next one.
"""

from cataloom.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
