"""The queries of this subpackage, one for each operator, by name; and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import op6_urls as _op6
from . import oracles as _oracles
from .op1_licenses import op1_licenses
from .op2_packing import op2_packing
from .op3_pieces import op3_pieces
from .op4_substrings import op4_substrings
from .op5_quality import op5_quality
from .op6_urls import op6_urls
from .op7_html import op7_html
from .op8_media import op8_media
from .op9_jaccard import op9_jaccard
from .op10_tokens import op10_token_counts
from .op11_exact import ORACLE_SQL as _EXACT
from .op11_exact import op11_exact
from .op12_compaction import op12_compaction
from .op13_middle import ORACLE_SQL as _MIDDLE
from .op13_middle import op13_middle

QUERIES = {f.__name__: f for f in (op1_licenses, op2_packing, op3_pieces, op4_substrings, op5_quality, op6_urls, op7_html, op8_media, op9_jaccard, op10_token_counts, op11_exact, op12_compaction, op13_middle)}
ORACLE_SQL: dict[str, str] = {"op1_licenses": _oracles.LICENSES, "op4_substrings": _oracles.SUBSTRINGS, "op5_quality": _oracles.QUALITY, "op6_urls": _op6.ORACLE_SQL, "op8_media": _oracles.MEDIA, "op9_jaccard": _oracles.JACCARD, "op11_exact": _EXACT, "op13_middle": _MIDDLE}
