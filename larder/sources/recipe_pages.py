"""Recipe records from stored detail pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.snapshots import spread

RECORD = "struct<img:string,title:string,quantity:string,time:string,difficulty:string,ingredients:array<struct<name:string,quantity:string>>,steps:array<struct<description:string,image:string>>>"
ARROW = pa.struct([*((n, pa.string()) for n in ("img", "title", "quantity", "time", "difficulty")), *((n, pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))) for n, a, b in (("ingredients", "name", "quantity"), ("steps", "description", "image")))])
VOID = {"img", "br", "input", "meta", "link", "hr", "source", "area", "base", "col", "embed", "wbr"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def nodes(self, tag: str | None = None) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and (tag is None or c.tag == tag)]

    def find(self, test) -> Node | None:
        for c in self.nodes():
            if test(c):
                return c
            if (found := c.find(test)) is not None:
                return found
        return None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.stack = [Node("", {})]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.stack[1:]):
            while self.stack.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _classed(name: str):
    return lambda n: name in (n.attrs.get("class") or "").split()


def record(html: str | None) -> dict | None:
    """The record of a page; null without summary, title, ingredients or steps. A malformed step ends the list of steps."""
    tree = _Tree()
    tree.feed(html or "")
    page = tree.stack[0]
    by_id = lambda name: page.find(lambda n: n.attrs.get("id") == name)
    summary, materials, start = page.find(_classed("view2_summary")), by_id("divConfirmedMaterialArea"), by_id("obx_recipe_step_start")
    title = summary and summary.find(lambda n: n.tag == "h3")
    if not (summary and title and materials and start):
        return None
    info = summary.find(lambda n: "view2_summary_info" in (n.attrs.get("class") or ""))
    spans = [s.text().strip() for s in info.nodes("span")] if info else []
    quantity, time, difficulty = [*spans, "", "", ""][:3]
    ingredients = []
    for item in (li for ul in materials.nodes("ul") for li in ul.nodes("li")):
        if not item.nodes("div") or not item.nodes("span"):
            return None
        ingredients.append({"name": item.nodes("div")[0].text().strip(), "quantity": item.nodes("span")[0].text().strip()})
    steps = []
    for block in start.nodes("div")[1:]:
        parts = block.nodes("div")
        image = parts[1].nodes("img") if len(parts) > 1 else []
        if not image:
            break
        steps.append({"description": parts[0].text().strip(), "image": image[0].attrs.get("src")})
    main = by_id("main_thumbs")
    return {"img": main.attrs.get("src") if main else None, "title": title.text().strip(), "quantity": quantity, "time": time, "difficulty": difficulty, "ingredients": ingredients, "steps": steps}


def recipe_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and the fields of the record of each page that has one."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([record(x) for x in batch.column(1).to_pylist()], ARROW)
            kept = found.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), found.filter(kept)], [key, "record"])

    kind = pages.schema[key].dataType.simpleString()
    return spread(pages.select(key, F.col(html)), key).mapInArrow(extract, f"{key} {kind}, record {RECORD}").select(key, "record.*")
