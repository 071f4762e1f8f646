"""The registered queries over the tables and their SQL counterparts."""

from .features import ORACLES as _FO, QUERIES as _FQ
from .pages import ORACLES as _PO, QUERIES as _PQ
from .statistics import ORACLES as _SO, QUERIES as _SQ
from .text import ORACLES as _TO, QUERIES as _TQ

QUERIES = _TQ | _SQ | _FQ | _PQ
ORACLES = _TO | _SO | _FO | _PO
