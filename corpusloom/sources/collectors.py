"""Collectors: network sources behind one interface, read with `collect` or as a registered Spark data source.

The library itself opens no connection. A collector takes a `fetch(url, params) -> str` function, so policy (robots,
retries, waiting) is one wrapper, and tests bring recorded answers.
"""

from __future__ import annotations

import json
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from urllib.parse import unquote, urljoin, urlparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import DOCUMENT
from .html import page_links, page_text

Fetch = Callable[[str, dict], str]


@dataclass
class Document:
    url: str
    text: str
    meta: dict[str, str] = field(default_factory=dict)


class Collector(ABC):
    def __init__(self, fetch: Fetch, **options):
        self.fetch, self.options = fetch, options

    @abstractmethod
    def documents(self) -> Iterator[Document]: ...


def patient(fetch: Fetch, attempts: int = 5, cap: float = 60.0, wait: Callable[[float], None] = time.sleep) -> Fetch:
    """Retries with doubling waits; an answer of `429` waits ten seconds more each time, sixty at most."""

    def call(url: str, params: dict) -> str:
        for attempt in range(attempts):
            try:
                return fetch(url, params)
            except OSError as e:
                if attempt + 1 == attempts:
                    raise
                wait(min(10 + 10 * attempt, 60) if "429" in str(e) else min(2**attempt, cap))
        raise AssertionError

    return call


def polite(fetch: Fetch, agent: str = "*") -> Fetch:
    """Asks robots.txt once per host; an unreadable one allows."""
    rules: dict[str, RobotFileParser | None] = {}

    def call(url: str, params: dict) -> str:
        host = "{0.scheme}://{0.netloc}".format(urlparse(url))
        if host not in rules:
            try:
                parser = RobotFileParser()
                parser.parse(fetch(f"{host}/robots.txt", {}).splitlines())
                rules[host] = parser
            except OSError:
                rules[host] = None
        if rules[host] and not rules[host].can_fetch(agent, url):
            raise PermissionError(f"robots.txt forbids {url}")
        return fetch(url, params)

    return call


class News(Collector):
    """Listing pages, links by selector, article text by selector, at most max_articles."""

    def documents(self):
        o, links = self.options, []
        for page in o["listings"]:
            links += page_links(self.fetch(page, {}), page, o.get("link_selector"))
        for url in list(dict.fromkeys(links))[: o.get("max_articles")]:
            text = page_text(self.fetch(url, {}), o.get("text_selector"), "\n")
            if text:
                yield Document(url, text, {"kind": "news"})


def locations(xml: str) -> list[str]:
    """Addresses that a sitemap lists, those of images left out, each once."""
    plain = re.sub(r"(?s)<image:image>.*?</image:image>", "", xml)
    return list(dict.fromkeys(re.findall(r"<loc>\s*(.*?)\s*</loc>", plain)))


def category_of(url: str) -> str:
    return url.rstrip("/").rsplit("/category/", 1)[-1].strip("/") or url


def leaf_categories(urls: list[str], excluded: list[str] = (), root: str = "uncategorized") -> list[str]:
    """Categories below which there is no other: none whose label begins another's, up to a slash."""
    labels = {category_of(u): u for u in urls}
    inner = {"/".join(parts[:n]) for parts in (x.split("/") for x in labels) for n in range(1, len(parts))}
    bad = lambda x: x == root or any(w.lower() in unquote(x).lower() for w in excluded)
    return [u for x, u in labels.items() if x not in inner and not bad(x)]


class Wordpress(Collector):
    """Posts by category, page after page until one brings no new link, or with `sitemap` those that it lists, chosen by
    slug patterns; exclusion wins. An address that cannot be fetched is passed over, a post without text too.

    Categories are the option `categories`, else those of the first sitemap that names some (leaves only), or of category
    sitemaps below it, else those that the home page links to.
    """

    def _tried(self, url: str) -> str:
        try:
            return self.fetch(url, {})
        except (OSError, PermissionError):
            return ""

    def _post(self, url: str, category: str) -> Iterator[Document]:
        text = page_text(self._tried(url), self.options.get("text_selector"), "\n")
        if text.strip():
            yield Document(url, text, {"category": category})

    def categories(self) -> list[str]:
        o, base = self.options, self.options["base"].rstrip("/") + "/"
        if o.get("categories"):
            return [urljoin(base, c.strip("/")) for c in o["categories"]]
        is_category = lambda urls: [u for u in urls if "/category/" in u]
        for name in ("category-sitemap.xml", "sitemap.xml", "sitemap_index.xml"):
            listed = locations(self._tried(base + name))
            if own := is_category(listed):
                return leaf_categories(own, o.get("exclude", []))
            below = [u for m in listed if "category" in m and m.endswith(".xml") for u in locations(self._tried(m))]
            if own := is_category(below):
                return list(dict.fromkeys(own))
        return list(dict.fromkeys(is_category(page_links(self._tried(base), base))))

    def _by_category(self) -> Iterator[Document]:
        for category in self.categories():
            seen: set[str] = set()
            for page in range(1, self.options.get("max_pages", 50) + 1):
                at = category if page == 1 else f"{category.rstrip('/')}/page/{page}/"
                new = [u for u in dict.fromkeys(page_links(self._tried(at), at, self.options.get("link_selector"))) if u not in seen]
                if not new:
                    break
                seen.update(new)
                for url in new:
                    yield from self._post(url, category_of(category))

    def _by_sitemap(self) -> Iterator[Document]:
        """A sitemap of posts, or an index of sitemaps, of which those of posts are read."""
        o, any_of = self.options, lambda patterns, name: any(re.search(p, name, re.I) for p in patterns)
        listed = locations(self._tried(o["sitemap"]))
        maps = [u for u in listed if "post-sitemap" in u]
        posts = dict.fromkeys(u for m in maps for u in locations(self._tried(m))) if maps else listed
        for url in posts:
            name = url.rstrip("/").rsplit("/", 1)[-1]
            if not any_of(o.get("exclude", []), name) and (not o.get("include") or any_of(o["include"], name)):
                yield from self._post(url, o.get("category", "sitemap"))

    def documents(self):
        yield from self._by_sitemap() if "sitemap" in self.options else self._by_category()


class Wiki(Collector):
    """Pages of a MediaWiki: all by continuation, or with mode `random` drawn ones, twenty a call, each title once, until
    `most` texts are found or ten draws in a row bring no new text."""

    def _answered(self, params: dict) -> dict:
        return json.loads(self.fetch(self.options["api"], {"action": "query", "format": "json"} | params))

    def _texts(self, answer: dict) -> Iterator[Document]:
        for page in answer.get("query", {}).get("pages", {}).values():
            if (page.get("extract") or "").strip():
                yield Document(urljoin(self.options["api"], f"?curid={page['pageid']}"), page["extract"], {"title": page.get("title", "")})

    def _all(self) -> Iterator[Document]:
        more = {}
        while more is not None:
            answer = self._answered({"generator": "allpages", "gaplimit": 20, "prop": "extracts", "explaintext": 1} | more)
            yield from self._texts(answer)
            more = answer.get("continue")

    def _drawn(self, fruitless: int = 10) -> Iterator[Document]:
        seen: set[str] = set()
        idle = 0
        while idle < fruitless:
            titles = {p["title"] for p in self._answered({"list": "random", "rnnamespace": 0, "rnlimit": 20}).get("query", {}).get("random", [])} - seen
            seen |= titles
            found = list(self._texts(self._answered({"prop": "extracts", "explaintext": 1, "titles": "|".join(sorted(titles))}))) if titles else []
            idle = 0 if found else idle + 1
            yield from found

    def documents(self):
        yield from islice(self._drawn() if self.options.get("mode") == "random" else self._all(), self.options.get("most"))


class CategoryTree(Collector):
    """Breadth-first walk over categories up to max_depth, each once, ten texts a call."""

    def documents(self):
        o = self.options
        seen, level, titles = {o["root"]}, [o["root"]], {}
        for _ in range(o.get("max_depth", 3) + 1):
            below = []
            for category in level:
                answer = json.loads(self.fetch(o["api"], {"action": "query", "list": "categorymembers", "cmtitle": category, "cmlimit": 500, "format": "json"}))
                for m in answer.get("query", {}).get("categorymembers", []):
                    if m["ns"] == 14 and m["title"] not in seen:
                        seen.add(m["title"])
                        below.append(m["title"])
                    elif m["ns"] != 14:
                        titles.setdefault(m["title"], category)
            level = below
        names = list(titles)
        for at in range(0, len(names), 10):
            answer = json.loads(self.fetch(o["api"], {"action": "query", "prop": "revisions", "rvprop": "content", "titles": "|".join(names[at : at + 10]), "format": "json"}))
            for page in answer.get("query", {}).get("pages", {}).values():
                for revision in page.get("revisions", [])[:1]:
                    yield Document(f"{o['api']}?title={page['title']}", revision.get("*", ""), {"category": titles.get(page["title"], "")})


class Forum(Collector):
    """Topic pages of a forum, page after page until one has no topic."""

    def documents(self):
        o, page, seen = self.options, 1, set()
        while True:
            links = [x for x in page_links(self.fetch(o["base"], {"page": page}), o["base"]) if "/forum/topics/" in x and ":Topic:" in x and x not in seen]
            if not links:
                return
            for url in links:
                seen.add(url)
                yield Document(url, page_text(self.fetch(url, {}), o.get("text_selector"), "\n"), {"kind": "forum"})
            page += 1


class Feed(Collector):
    """A blog feed by start-index: title and text, first category."""

    def documents(self):
        o, start = self.options, 1
        while True:
            feed = json.loads(self.fetch(o["feed"], {"alt": "json", "start-index": start, "max-results": o.get("batch", 100)}))["feed"]
            entries = feed.get("entry", [])
            for e in entries:
                url = next((x["href"] for x in e.get("link", []) if x.get("rel") == "alternate"), "")
                yield Document(url, f"{e['title']['$t']}\n{page_text(e.get('content', {}).get('$t', ''), None, chr(10))}", {"category": (e.get("category") or [{"term": ""}])[0]["term"]})
            start += len(entries)
            if not entries or start > int(feed["openSearch$totalResults"]["$t"]):
                return


class Threads(Collector):
    """Posts and comment trees of a discussion site by cursor; deleted and removed texts are left out."""

    def documents(self):
        o, after = self.options, None
        while True:
            data = json.loads(self.fetch(o["listing"], {"after": after, "limit": 100}))["data"]
            for post in data["children"]:
                own = post["data"]
                texts = [own.get("title", ""), own.get("selftext", "")]
                waiting = list(own.get("comments", []))
                while waiting:
                    c = waiting.pop(0)
                    texts.append(c.get("body", ""))
                    waiting += c.get("replies") or []
                kept = [t for t in texts if t and t not in ("[deleted]", "[removed]")]
                if kept:
                    yield Document(own.get("permalink", ""), "\n".join(kept), {"kind": "thread"})
            after = data.get("after")
            if not after:
                return


class Transcripts(Collector):
    """Rows of speech data: the first text key that is filled; rows marked synthetic are left out."""

    def documents(self):
        o = self.options
        for split in o["splits"]:
            for i, row in enumerate(json.loads(self.fetch(split, {}))):
                text = next((row[k] for k in o.get("keys", ["text", "transcript", "sentence"]) if row.get(k)), None)
                if text and not any("syn" in k.lower() and v is True for k, v in row.items()):
                    yield Document(f"{split}#{i}", text, {"split": split})


#: Sources by name; more can be registered.
COLLECTORS: dict[str, type[Collector]] = {"news": News, "wordpress": Wordpress, "wiki": Wiki, "category_tree": CategoryTree, "forum": Forum, "feed": Feed, "threads": Threads, "transcripts": Transcripts}


def collector(kind: str, fetch: Fetch, **options) -> Collector:
    if kind not in COLLECTORS:
        raise ValueError(f"unknown collector {kind}; known: {', '.join(sorted(COLLECTORS))}")
    return COLLECTORS[kind](fetch, **options)


def _read(source: str, fetch: Fetch) -> Iterator[Document]:
    options = json.loads(source)
    yield from collector(options.pop("kind"), fetch, **options).documents()


def collect(spark: SparkSession, sources: list[dict], fetch: Fetch, batch: int = 100) -> DataFrame:
    """Documents of several sources: one task per source runs its collector and holds `batch` documents at a time.
    sources: kind and options."""
    plan = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(sources)], "n int, source string").repartition(max(1, len(sources)), "n")

    def run(batches):
        for b in batches:
            for s in b["source"]:
                waiting = _read(s, fetch)
                while found := list(islice(waiting, batch)):
                    yield pd.DataFrame({"url": [d.url for d in found], "text": [d.text for d in found], "meta": [d.meta for d in found]})

    return plan.mapInPandas(run, DOCUMENT)


def register(spark: SparkSession, fetch: Fetch, name: str = "collected") -> None:
    """Makes collectors a data source: spark.read.format(name).option("sources", json).load(), where sources is a JSON
    array of objects with kind and options; one partition per source."""

    class Collected(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return DOCUMENT

        def reader(self, schema) -> DataSourceReader:
            return Reader(json.loads(self.options["sources"]))

    class Reader(DataSourceReader):
        def __init__(self, sources: list[dict]):
            for s in sources:
                if s.get("kind") not in COLLECTORS:
                    raise ValueError(f"unknown collector {s.get('kind')}")
            self.sources = sources

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(json.dumps(s)) for s in self.sources]

        def read(self, partition: InputPartition):
            for d in _read(partition.value, fetch):
                yield d.url, d.text, d.meta

    spark.dataSource.register(Collected)
