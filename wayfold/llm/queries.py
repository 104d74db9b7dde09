"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .html import op1_html
from .language import op9_language
from .licenses import op6_licenses
from .lines import op8_lines
from .media import op10_progressive_jpeg
from .minhash import op2_minhash
from .mixing import op3_mixing
from .packing import op7_packing
from .quality import op5_quality
from .substrings import op4_substrings

QUERIES = {
    f.__name__: f
    for f in (op1_html, op2_minhash, op3_mixing, op4_substrings, op5_quality, op6_licenses, op7_packing, op8_lines, op9_language, op10_progressive_jpeg)
}

#: Votes over hosts, hashed signatures, learned machines and binary formats are beyond SQL on whole
#: tables; README.md says what tests/llm holds each of them against.
ORACLES: dict[str, str] = {}
