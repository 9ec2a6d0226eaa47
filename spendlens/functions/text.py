"""Text Column functions: activity text, Unicode strip, request text, token proxy, cost.

All are built-in Spark expressions (whole-stage codegen, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens._compat import ColumnOrName, as_col

# Characters Python's str.strip() removes, derived by rule rather than listed:
# every code point whose str.isspace() is true (Unicode White_Space plus the
# four information separators U+001C..U+001F), 29 characters.
WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())

# Token proxy (our own choice, not the model's BPE count): runs of letters,
# runs of digits, runs of other non-space symbols.
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"

# Line that joins the sector name to the text in the user message.
SECTOR_SEPARATOR = "\nSector: "

# Price assumption, US$ per million tokens; output tokens = input tokens.
INPUT_RATE = 0.025
OUTPUT_RATE = 0.20
TOKENS_PER_PRICE_UNIT = 1_000_000


def ustrip(c: ColumnOrName) -> Column:
    """Strip Unicode whitespace at both ends (``str.strip()`` semantics).

    ``btrim`` with an explicit character set touches only the two ends of the
    string; a regex replace would scan and copy the whole text.
    """
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def is_blank(c: ColumnOrName) -> Column:
    """TRUE when the stripped text is empty; NULL text counts as blank."""
    return F.coalesce(F.length(ustrip(c)) == 0, F.lit(True))


def contains_ci(hay: ColumnOrName, needle: ColumnOrName) -> Column:
    """Case-insensitive containment by lower-casing both sides."""
    return F.lower(as_col(hay)).contains(F.lower(as_col(needle)))


def prefix_if_absent(text: ColumnOrName, part: ColumnOrName) -> Column:
    """``part + ' ' + text`` when ``part`` is non-empty and not already in ``text``."""
    t, p = as_col(text), F.coalesce(as_col(part), F.lit(""))
    return F.when((p != "") & ~contains_ci(t, p), F.concat(p, F.lit(" "), t)).otherwise(t)


def activity_text(title: ColumnOrName, short: ColumnOrName, long: ColumnOrName) -> Column:
    """One text per activity.

    Start from the long description, prefix the short one unless it is already
    contained, then prefix the title unless it is contained in the *extended*
    text; strip at the end. Nulls count as empty strings; parts are not
    stripped before the containment tests.
    """
    t = F.coalesce(as_col(long), F.lit(""))
    t = prefix_if_absent(t, short)
    t = prefix_if_absent(t, title)
    return ustrip(t)


def text_key(text: ColumnOrName) -> Column:
    """Content key of a text: hex SHA-256. Shuffles and joins use it instead of the text.

    A NULL text hashes as the empty text (both are blank, neither is ever
    labelled). ``sha2`` is declared nullable, so the outer ``coalesce`` makes the
    key provably non-NULL: the optimizer then infers no ``isnotnull(sha2(..))``
    join filter, which it would push below the projection and hash every text
    twice.
    """
    return F.coalesce(F.sha2(F.coalesce(as_col(text), F.lit("")), 256), F.lit(""))


def user_message(text: ColumnOrName, sector_name: ColumnOrName) -> Column:
    """The model's user turn: the text, then the sector line (empty name when unknown)."""
    return F.concat(as_col(text), F.lit(SECTOR_SEPARATOR), F.coalesce(as_col(sector_name), F.lit("")))


def request_payload(system_prompt: str, message: ColumnOrName) -> Column:
    """The two-message request as JSON (for sizing and for clients that take raw JSON)."""
    return F.to_json(
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
            F.struct(F.lit("user").alias("role"), as_col(message).alias("content")),
        )
    )


def token_count(text: ColumnOrName) -> Column:
    """Token proxy: number of TOKEN_PATTERN matches (0 for NULL)."""
    return F.coalesce(F.regexp_count(as_col(text), F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long")


def cost(
    tokens: ColumnOrName,
    input_rate: float = INPUT_RATE,
    output_rate: float = OUTPUT_RATE,
    output_ratio: float = 1.0,
    per: int = TOKENS_PER_PRICE_UNIT,
) -> Column:
    """Estimated price of ``tokens`` input tokens and ``output_ratio`` times as many output tokens."""
    t = as_col(tokens).cast("double")
    return t / per * input_rate + t * output_ratio / per * output_rate
