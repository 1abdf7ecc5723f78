"""Text of web pages as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_text(html: Column) -> Column:
    """A page without scripts, styles and tags, its white space in single spaces; a text that is no page stays as it is.

    What is opened and not closed goes to the end. Entities stay as they are written.
    """
    bare = html
    for name in ("script", "style"):
        bare = F.regexp_replace(bare, rf"(?is)<{name}.*?(?:</{name}[^>]*>|\z)", "")
    bare = F.replace(F.regexp_replace(bare, "<[^>]*>?", ""), F.lit(">"), F.lit(""))
    return F.when(html.contains("<html") | html.contains("<HTML"), F.regexp_replace(bare, r"[ \n\r\t]+", " ")).otherwise(html)
