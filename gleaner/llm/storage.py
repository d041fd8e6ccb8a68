"""Written intermediate tables; see :mod:`gleaner.storage`."""

from gleaner.storage import Workspace, join_checked, shared_folder

__all__ = ["Workspace", "join_checked", "shared_folder"]
