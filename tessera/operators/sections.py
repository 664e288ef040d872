"""Sections of XML articles, as a table function: the tree is walked with a stack of titles, one element after the other."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that are paragraphs of a section, and what joins the titles of a path.
PARAGRAPHS, JOINED = {"p", "list", "boxed-text"}, " > "
SCHEMA = "ordinal int, title string, path string, position int, char_start int, char_end int, text string, error string"


def local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def spelt(element: ET.Element) -> str:
    """The text of an element with single blanks."""
    return " ".join("".join(element.itertext()).split())


def sections(source: str | None) -> Iterator[tuple]:
    """Rows of SCHEMA of an article: its abstract first, then each section that has paragraphs of its own, outer before inner.

    A section without a title is named after its number. An article whose body
    has no sections is one. What isn't XML, and an article without abstract and
    body or without text, is one row with an error; null has no rows.
    """
    if source is None:
        return
    try:
        root = ET.fromstring(source)
    except ET.ParseError:
        yield (None,) * 7 + ("not well-formed",)
        return
    found: list[tuple[str, str, list[str]]] = []
    abstract = next((e for e in root.iter() if local(e.tag) == "abstract"), None)
    body = next((e for e in root.iter() if local(e.tag) == "body"), None)

    def deep(element: ET.Element) -> list[str]:
        return [t for e in element.iter() if local(e.tag) == "p" for t in [spelt(e)] if t]

    if abstract is not None and (texts := deep(abstract)):
        found.append(("Abstract", "Abstract", texts))
    if body is not None:
        outer = [e for e in body if local(e.tag) == "sec"]
        if not outer and (texts := deep(body)):
            found.append(("Body", "Body", texts))
        stack = [(e, ()) for e in reversed(outer)]
        while stack:
            element, above = stack.pop()
            head = next((e for e in element if local(e.tag) == "title"), None)
            title = spelt(head) if head is not None else f"Section {len(found) + 1}"
            path = (*above, title)
            if texts := [t for e in element if local(e.tag) in PARAGRAPHS for t in [spelt(e)] if t]:
                found.append((title, JOINED.join(path), texts))
            stack += [(e, path) for e in reversed(element) if local(e.tag) == "sec"]
    if not found:
        yield (None,) * 7 + ("no text" if body is not None else "no article body",)
    for ordinal, (title, path, texts) in enumerate(found):
        at = 0
        for position, text in enumerate(texts):
            yield ordinal, title, path, position, at, at + len(text), text, None
            at += len(text) + 2


class Sections:
    def eval(self, source: str):
        yield from sections(source)


def article_sections(spark: SparkSession, name: str = "article_sections") -> str:
    """Registers the table function for SQL, and gives back its name."""
    spark.udtf.register(name, F.udtf(Sections, returnType=SCHEMA))
    return name


def sections_of(articles: DataFrame, key: str, source: str | Column) -> DataFrame:
    """(key, ordinal, title, path, position, char_start, char_end, text, error) of each article's paragraphs."""
    walk = F.udtf(Sections, returnType=SCHEMA)
    rows = articles.select(F.col(key).alias("k"), (F.col(source) if isinstance(source, str) else source).alias("x"))
    return rows.lateralJoin(walk(F.col("x").outer())).select(F.col("k").alias(key), "ordinal", "title", "path", "position", "char_start", "char_end", "text", "error")
