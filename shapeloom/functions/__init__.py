"""Column-level functions."""
from shapeloom.functions.scalars import *  # noqa: F401,F403
