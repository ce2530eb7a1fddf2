"""Values that a worker process makes once.

Task functions travel by value, so their modules' globals are new in every task; this store hangs on the interpreter.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any


def once(key: tuple, make: Callable[[], Any]) -> Any:
    store = sys.__dict__.setdefault("_ledgerweave_once", {})
    if key not in store:
        store[key] = make()
    return store[key]
