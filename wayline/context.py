"""Parameters of a refresh job."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class JobContext:
    """Constants a job stamps on its rows, and the window it looks back over.

    ``as_of`` stands for "today": the window opens at midnight ``days`` days
    before it, that midnight itself excluded.
    """

    org: str = "LOCAL_ORG"
    account: str = "LOCAL_ACCOUNT"
    as_of: dt.date | None = None
    days: int = 30

    @property
    def since(self) -> dt.datetime:
        day = self.as_of or dt.date.today()
        return dt.datetime.combine(day, dt.time()) - dt.timedelta(days=self.days)
