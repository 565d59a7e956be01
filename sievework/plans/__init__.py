"""Queries over tables and their SQL twins; the modules register them as they load."""

from sievework.plans import registry  # noqa: F401, I001
from sievework.plans import cases  # noqa: F401
