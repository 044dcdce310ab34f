"""HTML to text: code in fences, one stripped line a text node's line, empty lines dropped."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag == "code":
            self.out.append("```\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag == "code":
            self.out.append("\n```")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def clean(html: str | None) -> str:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return "\n".join(line for x in "".join(reader.out).splitlines() if (line := x.strip()))


def clean_html(html: Column | str) -> Column:
    """Spark has no HTML parser, so pages go through the standard library's in Arrow batches."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(clean)

    return F.pandas_udf(run, "string")(html)
