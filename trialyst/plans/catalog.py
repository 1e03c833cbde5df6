"""Imports every module that registers queries."""

from trialyst.plans import summaries  # noqa: F401  isort: skip
from trialyst.plans import corpora, files, layouts, pairing, ranks, texts  # noqa: F401
