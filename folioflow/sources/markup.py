"""XML: counts, metadata and nested maps."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def element_counts(xml: Column) -> Column:
    """(elements, attributes, root) of a well-formed text."""
    return F.struct(F.xpath_int(xml, F.lit("count(//*)")).alias("elements"), F.xpath_int(xml, F.lit("count(//@*)")).alias("attributes"), F.xpath_string(xml, F.lit("name(/*)")).alias("root"))


def metadata(xml: Column) -> Column:
    """(root, encoding, title, author) of a well-formed text; what is not said is null."""
    said = lambda *names: F.coalesce(*(F.nullif(F.xpath_string(xml, F.lit(f"//{n}")), F.lit("")) for n in names))
    encoding = F.nullif(F.regexp_extract(xml, r"""^<\?xml[^>]*encoding=["']([^"']+)""", 1), F.lit(""))
    return F.struct(F.xpath_string(xml, F.lit("name(/*)")).alias("root"), encoding.alias("encoding"), said("title", "Title").alias("title"), said("author", "creator", "Author").alias("author"))


def lists(xml: Column, items: str = "//li | //item") -> Column:
    """The texts of list items."""
    return F.xpath(xml, F.lit(f"({items})/text()"))


def table_rows(xml: Column, rows: str = "//row | //tr") -> Column:
    """How many rows its tables have, and the texts of their cells in order."""
    return F.struct(F.xpath_int(xml, F.lit(f"count({rows})")).alias("rows"), F.xpath(xml, F.lit("(//row/* | //tr/td | //tr/th)/text()")).alias("cells"))


def tree(element: ET.Element) -> dict | str:
    """Attributes under @attributes, text under #text, repeated tags as lists."""
    out: dict = {"@attributes": dict(element.attrib)} if element.attrib else {}
    for child in element:
        value = tree(child)
        if child.tag in out:
            held = out[child.tag]
            out[child.tag] = [*held, value] if isinstance(held, list) else [held, value]
        else:
            out[child.tag] = value
    text = (element.text or "").strip()
    if not out:
        return text
    return out | ({"#text": text} if text else {})


def nested_maps(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, json, error): each text as nested maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    root = ET.fromstring(text or "")
                    found.append(json.dumps({root.tag: tree(root)}, ensure_ascii=False))
                    errors.append(None)
                except ET.ParseError as error:
                    found.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(errors, pa.string())], [key, "json", "error"])

    return df.select(key, xml).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, json string, error string")
