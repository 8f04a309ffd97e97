"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: speaker tags at the start of a line.
SPEAKER_TAG = "(?mdU)^(Assistant|AI|User):\\s*"


def strip(text: Column) -> Column:
    """Trim any Unicode whitespace from both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+\\z", "")


def strip_fences(text: Column) -> Column:
    """Content of a fenced code block; text without an opening fence is only trimmed."""
    trimmed = strip(text)
    without_head = F.regexp_replace(trimmed, "\\A```[^\\n]*\\n", "")
    without_tail = F.regexp_replace(without_head, "(?U)```\\s*\\z", "")
    return F.when(trimmed.startswith("```"), strip(without_tail)).otherwise(trimmed)


def truncate_text(text: Column, limit: int = 8000, marker: str = "\n\n[... truncated]") -> Column:
    """Cut at ``limit`` characters and append the marker, only when the text is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` placeholders by column values, left to right."""
    filled = F.lit(template)
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    return filled
