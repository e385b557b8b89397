"""Streams: command logs and search results that arrive file by file.

The batch operators know no streams; these are their incremental forms.
"""

from seqloom.streaming.logs import *  # noqa: F401,F403
