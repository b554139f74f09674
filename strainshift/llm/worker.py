"""Objects that later tasks of the same Python worker find again.

Functions travel to workers by value, so their own globals last for one task. What is kept
here lasts as long as the worker. It may only save time: results never depend on it.
"""

from __future__ import annotations

import sys
import types


def kept(name: str, make):
    """The object of that name, made on first use."""
    place = sys.modules.setdefault("strainshift_worker", types.ModuleType("strainshift_worker"))
    if name not in place.__dict__:
        place.__dict__[name] = make()
    return place.__dict__[name]
