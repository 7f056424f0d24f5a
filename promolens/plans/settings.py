"""Parameters used by the registered queries over the driver tables."""

from __future__ import annotations

import datetime as dt

from promolens.params import Params

AS_OF = dt.date(2001, 7, 18)
FOCAL = "AFRICA"
PARAMS = Params(as_of=AS_OF, focal=FOCAL)
COMPANIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PREFERRED = ("AFRICA", "EUROPE", "ASIA")
TREND_SINCE, TREND_UNTIL = dt.date(2001, 4, 1), AS_OF
