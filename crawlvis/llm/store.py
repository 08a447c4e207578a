"""Intermediate tables of this subpackage's operators, in the folder that the whole cluster shares."""

from crawlvis.sources.shared import dropped, new_path, shared_folder, spread, written, written_bytes

__all__ = ["dropped", "new_path", "shared_folder", "spread", "written", "written_bytes"]
