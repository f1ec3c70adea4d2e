"""Readable text and metadata of web pages, with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..tables import ship

# Elements without readable text, and marks of elements that are not the article.
DROPPED = frozenset("script style nav header footer aside noscript iframe form button svg canvas template".split())
NOISE = ("nav", "menu", "sidebar", "footer", "header", "cookie", "banner", "advert", "ads", "social", "share", "comment", "related", "promo", "popup", "modal", "newsletter")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE = re.compile(r"\b(?:" + "|".join(NOISE) + r")\b", re.IGNORECASE)
SCHEMA = "title string, author string, published string, description string, text string"


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title, self.in_title = "", False
        self.stack: list[tuple[str, bool, bool]] = []  # tag, inside what is dropped, inside the article
        self.body: list[str] = []
        self.article: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a["content"].strip())
        if tag == "time" and a.get("datetime"):
            self.meta.setdefault("time", a["datetime"])
        if tag in VOID:
            return
        _, dropped, article = self.stack[-1] if self.stack else ("", False, False)
        dropped |= tag in DROPPED or (tag not in ("html", "body", "article", "main") and bool(_NOISE.search(f"{a.get('class', '')} {a.get('id', '')}")))
        article |= tag in ("article", "main") or a.get("role") == "main" or bool(re.search(r"\bcontent\b", f"{a.get('class', '')} {a.get('id', '')}"))
        self.in_title |= tag == "title"
        self.stack.append((tag, dropped, article))

    def handle_endtag(self, tag: str) -> None:
        self.in_title &= tag != "title"
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif self.stack and not self.stack[-1][1] and data.strip():
            self.body.append(data.strip())
            if self.stack[-1][2]:
                self.article.append(data.strip())


def clean(text: str) -> str:
    """Single spaces, at most one empty line, no spaces around lines."""
    lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def read(html: str) -> tuple[str | None, str | None, str | None, str | None, str]:
    page = _Page()
    page.feed(html)
    page.close()
    m = page.meta
    title = m.get("og:title") or re.split(r"\s+[|—-]\s+", page.title.strip())[0] or None
    article = "\n".join(page.article)
    text = article if len(article) > 100 else "\n".join(page.body)
    return title, m.get("author") or m.get("article:author"), m.get("article:published_time") or m.get("time"), m.get("description") or m.get("og:description"), clean(text)


def page_text(html: Column) -> Column:
    """A struct of title, author, published, description and text."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf(SCHEMA)
    def take(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(p or "") for p in pages], columns=["title", "author", "published", "description", "text"])

    return take(html)
