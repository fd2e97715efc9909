"""Fields of site pages: links, label-value pairs, text between labels, descriptions. HTML comes as a table; nothing is fetched."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalar as S

#: The labels of a site page.
LABELS = ("Planet(s)", "Estimated light years from the bubble", "Material Type", "Mining Type", "Overlap #", "Thanks to:")
LISTED = "/mining-location/"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def one_space(text: str) -> str:
    return " ".join(text.split())


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def all(self) -> Iterator["Element"]:
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def named(self, *tags: str) -> list["Element"]:
        return [e for e in self.all() if e.tag in tags]

    def text(self) -> str:
        parts: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                todo.extend(reversed(x.children))
        return one_space(" ".join(parts))


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        element = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(element)
        if tag not in VOID:
            self.at = element

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def label_key(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", label.lower())


def label_values(root: Element) -> dict[str, str]:
    """Values by label: of table rows, then of term lists, then of blocks "label: value"; the first of a label stays."""
    found: list[tuple[str, str]] = []
    for row in root.named("tr"):
        cells = row.named("th", "td")
        if len(cells) > 1:
            found.append((cells[0].text(), cells[1].text()))
    for term in root.named("dt"):
        siblings = [c for c in term.parent.children if isinstance(c, Element)]
        after = [c for c in siblings[siblings.index(term) + 1 :] if c.tag == "dd"]
        if after:
            found.append((term.text(), after[0].text()))
    for block in root.named("p", "li", "div"):
        label, colon, value = block.text().partition(":")
        if colon and len(label.strip()) <= 64:
            found.append((label.strip(), value.strip()))
    out: dict[str, str] = {}
    for label, value in found:
        if label and value:
            out.setdefault(label_key(label.rstrip(":")), value)
    return out


#: Fixed value: what is trimmed from a labelled value.
TRIMMED = " :,-#"


def between(text: str, label: str, stops: tuple[str, ...] = LABELS) -> str:
    """The text after a label and before the nearest of the stop labels."""
    _, found, rest = text.partition(m[0]) if (m := re.search(re.escape(label), text, re.IGNORECASE)) else ("", "", "")
    if not found:
        return ""
    stop = re.compile("|".join(re.escape(s) for s in stops), re.IGNORECASE)
    return one_space(stop.split(rest, maxsplit=1)[0]).strip(TRIMMED)


def description(root: Element) -> str | None:
    """The first two different paragraphs that are no labelled values."""
    kept: list[str] = []
    for p in root.named("p"):
        text = p.text()
        if text and text not in kept and not (":" in text and len(text.split(":", 1)[0]) < 40):
            kept.append(text)
            if len(kept) == 2:
                break
    return "\n\n".join(kept) or None


def site(html: str) -> dict:
    root = Tree(html).root
    heads, titles = root.named("h1"), root.named("title")
    name = heads[0].text() if heads else ""
    name = name or (titles[0].text().split("|")[0].strip() if titles else "")
    labels = label_values(root)
    blocks = (e.text() for e in root.all())
    block = next((t for t in blocks if "mining location" in t.lower() and any(x.rstrip(":").lower() in t.lower() for x in LABELS)), root.text())
    labelled = lambda *parts: next((v for k, v in labels.items() if any(p in k for p in parts)), "")
    material = between(block, "Material Type") or labelled("materialtype", "materials")
    return {
        "system_name": name,
        "planets": between(block, "Planet(s)") or labelled("planet") or None,
        "estimated_raw": between(block, LABELS[1]) or labelled("estimatedlightyears", "estimatedly", "lightyearsfromthebubble"),
        "material_type_raw": material,
        "mining_type": between(block, "Mining Type") or labelled("miningtype") or None,
        "overlap": between(block, "Overlap #") or labelled("overlap") or None,
        "thanks_to": labelled("thanksto", "thanks") or between(block, "Thanks to:") or None,
        "description": description(root),
        "parse_warnings": None if material else "materials_missing",
    }


FIELDS = "system_name string, planets string, estimated_raw string, material_type_raw string, mining_type string, overlap string, thanks_to string, description string, parse_warnings string"


def parse_sites(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A record per page, with materials and whether tritium is named (explicit) or to be inferred. Null pages give empty records."""

    @F.pandas_udf(FIELDS)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([site(t or "") for t in texts], columns=[f.split()[0] for f in FIELDS.split(", ")])

    rows = pages.select(S.canonical_url(url).alias("source_url"), parsed(F.col(html)).alias("s")).select("source_url", "s.*")
    rows = rows.withColumn("estimated_ly", S.number_in_text("estimated_raw")).withColumn("materials", S.materials("material_type_raw"))
    explicit = F.lower("material_type_raw").contains("tritium").cast("int")
    return rows.withColumn("tritium_explicit", explicit).withColumn("tritium_inferred", 1 - explicit).drop("estimated_raw")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, pos, link): the page's links in order, as written, without query and fragment, each once."""
    found = pages.select(F.col(url).alias("url"), F.posexplode(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return found.groupBy("url", S.canonical_url("href").alias("link")).agg(F.min("pos").cast("bigint").alias("pos"))


def listing(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, links, next_url): the absolute links of a listing page to locations, first seen first, and the next page (rel, else text)."""

    @F.pandas_udf("links array<string>, next_url string")
    def parsed(urls: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for base, text in zip(urls, texts, strict=True):
            anchors = [(urljoin(base or "", a.attrs["href"]).split("?")[0].split("#")[0], a) for a in Tree(text or "").root.named("a") if "href" in a.attrs]
            following = next((u for u, a in anchors if "next" in a.attrs.get("rel", "").lower().split()), None) or next((u for u, a in anchors if "next" in a.text().lower()), None)
            out.append((list(dict.fromkeys(u for u, _ in anchors if LISTED in u)), following))
        return pd.DataFrame(out, columns=["links", "next_url"])

    return pages.select(F.col(url).alias("url"), parsed(F.col(url), F.col(html)).alias("p")).select("url", "p.*")


def unseen(links: DataFrame, done: DataFrame, url: str = "source_url") -> DataFrame:
    """The links of which no record is there yet."""
    return links.join(done.select(S.canonical_url(url).alias(url)).distinct(), url, "left_anti")
