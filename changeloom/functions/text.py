"""Text expressions: lines, normal forms, identifiers, quotes, requirements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: normalised lines that carry no meaning on their own
TRIVIAL = ["else{", "}else{", "return;", "break;", "pass", "continue;", "});", "end"]
MIN_PROMPT_WORDS, MAX_PROMPT_CHARS = 4, 1200


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def norm_line(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\s+", "")


def is_nontrivial(norm: Column) -> Column:
    return (F.octet_length(norm) >= 4) & norm.rlike(r"[\p{L}\p{N}]") & ~norm.isin(TRIVIAL)


def mentions(line: Column, name: str) -> Column:
    """Does the identifier stand in the line by itself?"""
    q = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in name)
    return line.rlike(rf"(?<![A-Za-z0-9_$]){q}(?![A-Za-z0-9_$])")


def _flat(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def stripped_quote(quote: Column) -> Column:
    """Without the quote marks, dots and white space around it."""
    return F.regexp_replace(quote, r"(?U)^[\"'…\s]+|[\"'…\s]+$", "")


def quote_in(quote: Column, text: Column) -> Column:
    """Is the quote, of three bytes or more, in the text but for case and white space?"""
    q = _flat(stripped_quote(quote))
    return (F.octet_length(q) >= 3) & F.contains(_flat(text), q)


def requirement(text: Column) -> Column:
    """What a person asked for: no reminder blocks, no harness text, four words or more, 1200 characters at most; else null."""
    t = F.trim(F.regexp_replace(text, r"(?s)<system-reminder>.*?(</system-reminder>|$)", ""))
    harness = t.rlike(r"^(<|Caveat:|\[Request interrupted|# AGENTS\.md instructions)") | t.contains("<INSTRUCTIONS>")
    enough = F.size(F.array_remove(F.split(t, r"(?U)\s+"), "")) >= MIN_PROMPT_WORDS
    short = F.when(F.length(t) > MAX_PROMPT_CHARS, F.concat(F.substring(t, 1, MAX_PROMPT_CHARS), F.lit("…"))).otherwise(t)
    return F.when(~harness & enough, short)


def epoch_seconds(ts: Column) -> Column:
    """Seconds of an ISO time by its first 19 characters; an offset is ignored."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(ts, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
