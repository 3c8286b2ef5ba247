"""Links of stored pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("a", "link", "area") and (url := (dict(attrs).get("href") or "").strip()):
            self.found.append(url)


def links(html: str | None) -> list[str]:
    parser = _Links()
    parser.feed(html or "")
    return parser.found


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row for each link of a page, in order; blank ones are skipped."""

    @F.pandas_udf("array<string>")
    def extract(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(links)

    return pages.select(key, F.posexplode(extract(html)).alias("place", "url")).withColumn("place", F.col("place") + 1)
