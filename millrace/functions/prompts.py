"""Untrusted text on its way into a prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import any_of, nfkc, rstrip, strip

# The envelope, and phrases that try to take it over.
BEGIN, END = "<<<UNTRUSTED_JOB_DESCRIPTION>>>", "<<<END_UNTRUSTED_JOB_DESCRIPTION>>>"
SUSPICIOUS = (
    "ignore previous", "ignore all previous", "disregard the above", "disregard previous",
    "new instructions", "system prompt", "you are now", "act as though", "reveal your instructions",
    "print your instructions",
)
CHARS_PER_TOKEN = 4
NOTE = "\n[truncated]"
#: Nearly all text is printable ASCII, which one range tells ahead of longer classes.
_BREAKS = r"(?![ -~])(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
#: Encoded data, tried at its first character only, and only where no blank is near.
_CODED = "(?=[!-~]{200})(?<![a-zA-Z/-9+=])[a-zA-Z/-9+=]{200,}+"


def without_controls(text: Column) -> Column:
    """NFKC without invisible, bidirectional and control characters, all of which are of category C; newline and tab stay."""
    return F.regexp_replace(nfkc(text), r"[\p{C}&&[^\n\t]]+", "")


def collapsed_lines(text: Column) -> Column:
    """Lines without white space at their ends, blank runs as one line."""
    lines = F.transform(F.split(text, _BREAKS), rstrip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def truncated_tokens(text: Column, tokens: int) -> Column:
    limit = max(1, tokens) * CHARS_PER_TOKEN
    cut = F.left(text, F.lit(limit))
    space = limit - F.instr(F.reverse(cut), " ")  # position of the last space, from 0
    near = F.contains(cut, F.lit(" ")) & (space > limit - 200)
    cut = F.when(near, F.left(cut, space)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(rstrip(cut), F.lit(NOTE)))


def sanitised(text: Column, tokens: int) -> Column:
    text = F.regexp_replace(text, r"<<<[/A-Za-z_ ]{3,60}>>>", "[removed]")
    text = F.regexp_replace(without_controls(text), _CODED, "[removed]")
    return truncated_tokens(collapsed_lines(text), tokens)


def envelope(text: Column, tokens: int) -> Column:
    return F.concat_ws("\n", F.lit(BEGIN), sanitised(text, tokens), F.lit(END))


def suspicious(text: Column) -> Column:
    lowered = F.lower(text)
    return any_of([F.contains(lowered, F.lit(p)) for p in SUSPICIOUS])
