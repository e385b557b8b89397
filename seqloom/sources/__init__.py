"""Readers of the text formats of sequence analysis, each with an explicit schema."""

from seqloom.sources.readers import *  # noqa: F401,F403
