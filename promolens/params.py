"""Run parameters shared by every job.

Nothing in the library reads the clock or a fixed company name: the reference
date, the focal company and all keyword lists arrive through ``Params``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from promolens.vocabulary import Vocabulary


@dataclass(frozen=True)
class Params:
    as_of: dt.date
    focal: str
    focal_match: str = "eq"  # "eq" on stored data, "contains" for the dashboard variant
    vocab: Vocabulary = field(default_factory=Vocabulary)

    ingest_limit_per_company: int | None = None  # None takes every row
    benchmark_items: int = 20
    gap_rival_items: int = 10
    gap_weeks: int = 8
    corpus_rows: int | None = 20  # None takes every text
    recent_days: int = 7
    ending_days: int = 14

    def __post_init__(self) -> None:
        if self.focal_match not in ("eq", "contains"):
            raise ValueError("focal_match must be 'eq' or 'contains'")
        if not 1 <= self.gap_weeks <= 520:
            raise ValueError("gap_weeks must be between 1 and 520")
