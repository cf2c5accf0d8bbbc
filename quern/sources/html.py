"""HTML to plain text with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Elements that end a line, and the character references that are decoded.
BLOCKS = "p|div|br|h[1-6]|li|tr|ul|ol|table|section|article|header|footer|nav|blockquote|pre|hr"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def strip_tags(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; cells become tabs, blocks lines, blank runs shrink."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(</\1\s*>|\z)|<!--.*?(-->|\z)", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</?(?:td|th)\b[^>]*>", "\t")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \r\f]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))
