"""Writers of the text formats of sequence analysis."""

from seqloom.sinks.writers import *  # noqa: F401,F403
