"""Every query by name, with its SQL where there is one."""

from __future__ import annotations

from . import flows, market, more, places, prices, roads, space  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
