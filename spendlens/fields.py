"""Column names the stages read and add.

Defaults are the names of the source activity files; every operator takes a
``Fields`` so other layouts (and the test fixtures) can map their own names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Fields:
    year: str = "Year"
    amount: str = "USD_Disbursement_Defl"
    purpose_code: str = "PurposeCode"
    category: str = "Category"
    title: str = "ProjectTitle"
    short_description: str = "ShortDescription"
    long_description: str = "LongDescription"
    text: str = "text"
    # content key of ``text``: sha2(text, 256), hex
    key: str = "text_key"
    # stable ingest ordinal used for first-wins dedup
    ordinal: str = "ord"
    sector_flag: str = "Sector code"
    any_flag: str = "any"
    any_sans_sector: str = "any_sans_sector"
    # suffix given to label columns that clash with source columns
    clash_suffix: str = "_label"

    def with_(self, **kw) -> "Fields":
        return replace(self, **kw)


DEFAULT = Fields()
