"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks, cut at block-level tags. A block is
described by its number of words and its link density, those of the blocks
before and after it, and by the kind of elements around it. A decision tree,
fitted by Spark on the blocks of the small labelled pages in ``LABELLED``,
tells main text from the rest. Text that is never shown (scripts, styles,
comments in the markup, hidden elements, form controls) makes no blocks.

White space inside a block becomes one space, and blocks are joined in page
order by one space. Null and empty pages have an empty text. Unclosed and
stray tags are taken as browsers take them, as far as blocks depend on it;
a comment, declaration or tag that the page doesn't end is not text.
Rows with a repeated page_id are extracted one by one.
"""

from __future__ import annotations

import dataclasses
import random
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burrow.llm.common import scan
from burrow.llm.trees import fitted, once, predict

DEPTH = 6

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt rtc "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset(
    "head script style noscript template title iframe object svg math canvas audio video select option button textarea "
    "datalist map".split()
)
#: Elements that the start of another one ends, up to the nearest border.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BORDERS = frozenset("ul ol dl table div article section main body td nav aside footer header form".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
_CHROME = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|breadcrumbs?|foot\w*|header|masthead|topbar|toolbar|side\w*|rail|widgets?|ads?|advert\w*|"
    r"sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|share\w*|social\w*|comments?|"
    r"commentlist|disqus|repl(?:y|ies)|respond|subscribe|newsletter|signup|login|related|recommend\w*|copyright|legal|pagination|"
    r"pager|search\w*|skip\w*|contentinfo|complementary|navigation|dialog)(?:$|[\s_-])",
    re.I,
)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|body-?text)(?:$|[\s_-])", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = [
    "words",
    "link_density",
    "words_before",
    "link_density_before",
    "words_after",
    "link_density_after",
    "in_chrome_tag",
    "in_chrome_class",
    "in_article",
    "heading",
    "list_item",
    "marked",
]


@dataclasses.dataclass
class Block:
    text: str
    words: int
    linked: int
    chrome_tag: bool
    chrome_class: bool
    article: bool
    heading: bool
    item: bool
    label: bool


@dataclasses.dataclass(frozen=True)
class Open:
    """An open element, and what its ancestors and it say of the text inside."""

    tag: str = ""
    unseen: bool = False
    chrome_tag: bool = False
    chrome_class: bool = False
    article: bool = False
    label: bool = False
    heading: bool = False
    item: bool = False
    linked: bool = False


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Blocks(HTMLParser):
    """Flat text blocks of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[Open] = []
        self.times: Counter = Counter()  # of open tags
        self.data: list[str] = []
        self.linked = 0

    def parse_html_declaration(self, i):
        """Whatever follows ``<!`` is a comment to its end, as browsers take it."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else -1

    def finish(self):
        """The page ends here: a tag or comment that isn't closed is not text."""
        if at := _MARKUP.search(self.rawdata):
            self.rawdata = self.rawdata[: at.start()]
        self.close()
        self.flush()

    def top(self) -> Open:
        return self.open[-1] if self.open else Open()

    def flush(self):
        words = "".join(self.data).split()
        if words:
            top = self.top()
            linked = min(self.linked, len(words))
            flags = (top.chrome_tag, top.chrome_class, top.article, top.heading, top.item, top.label)
            self.blocks.append(Block(" ".join(words), len(words), linked, *flags))
        self.data, self.linked = [], 0

    def _close(self, at: int):
        self.times.subtract(e.tag for e in self.open[at:])
        del self.open[at:]

    def _last(self, tags, border=frozenset()) -> int:
        if not any(self.times[t] for t in tags):
            return -1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in tags:
                return at
            if self.open[at].tag in border:
                return -1
        return -1

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE:
            self.flush()
        if tag in _VOID:
            if tag == "br":
                self.data.append(" ")
            return
        if tag == "body" and (at := self._last({"head"})) >= 0:
            self._close(at)
        if tag in _ENDS_P and (at := self._last({"p"}, _BORDERS)) >= 0:
            self._close(at)
        if tag in _ENDS and (at := self._last(_ENDS[tag], {"ul", "ol", "dl", "table"})) >= 0:
            self._close(at)
        if tag in ("article", "main") and (at := self._last({"nav", "header"})) >= 0:
            self._close(at)  # menus don't hold the article; their end is missing
        values = {k: v or "" for k, v in attrs}
        up = self.top()
        names = f"{values.get('class', '')} {values.get('id', '')} {values.get('role', '')}"
        chrome_tag, chrome_class, article = up.chrome_tag, up.chrome_class, up.article
        if tag not in ("html", "body"):
            main = tag in ("article", "main") or bool(_MAIN.search(names))
            chrome_class = chrome_class or bool(_CHROME.search(names)) and tag not in ("article", "main")
            article = article or main
            chrome_tag = chrome_tag or tag in ("nav", "footer", "aside", "form", "dialog", "menu") or (
                tag == "header" and not article
            )
        unseen = (
            up.unseen
            or tag in _UNSEEN
            or "hidden" in values
            or values.get("aria-hidden", "").lower() == "true"
            or bool(_HIDING.search(values.get("style", "")))
        )
        label = (up.label or "data-main" in values) and "data-rest" not in values
        here = (up.heading or tag in _HEADINGS, up.item or tag == "li", up.linked or tag == "a")
        self.open.append(Open(tag, unseen, chrome_tag, chrome_class, article, label, *here))
        self.times[tag] += 1

    def handle_endtag(self, tag):
        if tag not in _INLINE:
            self.flush()
        if (at := self._last({tag}, _BORDERS - {tag} if tag in _INLINE or tag in ("p", "li") else frozenset())) >= 0:
            self._close(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "iframe", "svg", "path", "span", "div"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        top = self.top()
        if top.unseen:
            return
        self.data.append(data)
        if top.linked:
            self.linked += len(data.split())


_MARKUP = re.compile(r"<[A-Za-z/!?]")
_MARKED = re.compile(r"^(?:©|\(c\)\s|copyright\b|all rights reserved|advertisement$|share this|we use cookies)", re.I)


def blocks_of(html: str) -> list[Block]:
    parser = Blocks()
    parser.feed(html)
    parser.finish()
    return parser.blocks


def described(blocks: list[Block]) -> list[tuple[float, ...]]:
    """The features of each block, among its neighbours."""
    sizes = [(b.words, b.linked / b.words) for b in blocks]
    sizes = [(0, 0.0), *sizes, (0, 0.0)]
    return [
        tuple(
            map(
                float,
                (
                    *sizes[k + 1],
                    *sizes[k],
                    *sizes[k + 2],
                    b.chrome_tag,
                    b.chrome_class,
                    b.article,
                    b.heading,
                    b.item,
                    bool(_MARKED.search(b.text)),
                ),
            )
        )
        for k, b in enumerate(blocks)
    ]


#: Small labelled pages, written for this library: data-main marks main text.
LABELLED = (
    """<header class="top"><a href="/">River News</a> <span>Daily notes from the valley</span></header>
    <nav><ul><li><a href=1>Home</a><li><a href=2>Sports</a><li><a href=3>About us</a></ul></nav>
    <article data-main><h1>Bridge opens again</h1><p>The old bridge over the river opened again on Monday after two years of work on its piers.
    <p>Traffic was light.<p>Mayor spoke. <ul><li>Two lanes are open</li><li>Trucks use the <a href=x>northern road</a> for now</li></ul>
    <p>A short ceremony with music took place in the morning, and most of the town came to see it.</article>
    <aside><h2>Most read</h2><ul><li><a href=1>Ten walks for the weekend</a><li><a href=2>Market prices rise</a></ul>
    <p>Write to us if you have seen something on the way to work that others should know about.</aside>
    <footer>&copy; River News. <a href=a>Imprint</a> All rights reserved by the publishers of this paper in the valley.</footer>""",
    """<div class="ad">Buy two lamps today and get the third lamp free of charge in all our shops.</div>
    <div class="cookie-notice"><p>We use cookies to measure how this site is read and to keep you signed in.</p></div>
    <div id="content"><div data-main><h2>How bread rises</h2><p>Yeast turns sugar into gas, and gas makes the dough grow until the oven sets it.</p><p>Wait.</p>
    <p>Warm dough is quicker than cold dough, but cold dough tastes better, as bakers have known for a long time.</p></div></div>
    <div class="comments"><h3>3 comments</h3><p>I tried this at home and the bread came out flat, what did I do wrong here?</p><p>Great text</p></div>
    <div class="sidebar"><p>Our baker answers letters from readers each Friday on this page, so write early.</p><a href=s>Subscribe</a></div>""",
    """<div><a href=1>Home</a> | <a href=2>Forum</a> | <a href=3>Contact</a></div>
    <div><p data-main>The committee met on Tuesday to talk about the plan for the harbour, which has been put off since spring.</p>
    <p data-main>It will meet again in <a href=4>two weeks</a>, when the figures for the cost of the new wall have come in.</p>
    <p data-main>Nobody objected.</p><p data-main>The minutes will be read out at the start of the next meeting, as always.</p></div>
    <div><a href=5>Back to the start</a> <a href=6>Next page</a> <a href=7>Archive of all texts</a></div>
    <form action=s><label>Search the archive of this site by word</label><input name=q></form><p>Copyright by the harbour committee</p>""",
    """<div class="menu"><p>Start</p><p>Products and services for your garden</p></div>
    <main data-main><header><h1>Watering in summer</h1></header><p>Water early.</p><p>Plants drink most in the hours before noon, so water them at dawn.</p>
    <h2>Pots</h2><p>Small pots dry out fast.</p><blockquote>Never let them stand in water over night.</blockquote>
    <ol><li>Check the soil</li><li>Water slowly</li></ol></main>
    <div role="complementary"><p>Seeds for autumn are in the shop from the first of August, with free delivery.</p></div>
    <section class="newsletter-signup"><p>Get a letter with a tip for your garden each week, free of charge.</p></section>
    <footer><p>Garden House, opening hours nine to five, closed on Sundays and holidays.</p><nav><a href=i>Imprint</a></nav></footer>""",
    """<nav><a href=1>Politics</a> <a href=2>Culture</a></nav><div class="ad">Der beste Kaffee.</div>
    <article data-main><h1>Un jour d'été</h1><p>Le matin.</p><p>La ville dort encore, et les rues sont vides jusqu'au port où les bateaux attendent.</p><p>Fin</p>
    <p><a href=3>Le port</a></p><p>Il fait chaud dès huit heures, et chacun cherche l'ombre des arbres sur la place.</p></article>
    <div class="share-buttons"><p>Share this text with your friends</p></div><div class="related"><h3>Read next</h3><p><a href=4>Un soir d'hiver</a></p></div>
    <aside class="notice"><p>This text was first printed in the summer issue and may not be copied without leave.</p></aside>
    <footer>Impressum und Datenschutz. Die Redaktion haftet nicht für den Inhalt fremder Seiten.</footer>""",
)


#: Sentences and names that pages are composed of; written for this library.
SENTENCES = (
    "The council voted on the new plan for the old town after a long evening.", "Nobody was hurt.", "It rained for three days.",
    "A team of six people measured the depth of the lake from the northern shore to the dam.", "The reason is simple.",
    "Prices rose again in the second half of the year, and most shops had to follow.", "They left early, before the road was closed.",
    "In the museum next door one can see how the machine was built and what it was used for in its first years.",
    "Die Arbeiten an der Brücke dauern länger als geplant, weil im Sommer Teile fehlten.", "Niemand war überrascht.",
    "La maison a été vendue au printemps, et les nouveaux propriétaires veulent la garder comme elle est.", "Tout va bien.",
    "Los vecinos se reunieron en la plaza para hablar de la escuela y de los árboles del parque.", "Nadie lo sabía.",
    "Cut the apples into thin slices and lay them in rings on the dough.", "Serve warm.",
)
ASIDES = (
    "Our editors pick the best stories of the week for you and send them each Sunday morning.", "Two for one until Friday in every branch.",
    "By staying on this page you agree that small files are stored on your device, as our terms describe.", "Thanks, very useful!",
    "I don't agree with the second point, because the figures are from before the change.", "Write a reply to this text here.",
    "All texts on these pages belong to their authors and may be passed on only with their written leave.", "Shipping is free from forty.",
    "Wir verwenden kleine Dateien, damit diese Seite besser läuft.", "Abonnez-vous à notre lettre pour ne rien manquer.",
    "Company number 4711, registered office at the old harbour, managing director as named in the register.", "Please sign in to go on.",
)
NAMES = ("Home", "About us", "Contact", "Sports", "Weather today", "All recipes", "Imprint", "Help", "Shop", "Newest first", "Archive 2019", "Log in")
_WRAPS = (
    "<article data-main>{}</article>", "<main data-main>{}</main>", '<div id="content"><div data-main>{}</div></div>', "<div data-main>{}</div>",
    '<section class="story" data-main>{}</section>', "<main><article data-main>{}</article></main>", '<div class="post-body" data-main>{}</div>',
)
_BESIDE = (
    "<aside data-rest>{}</aside>", '<div class="comments" data-rest>{}</div>', '<div class="ad" data-rest>{}</div>', "<form data-rest>{}</form>",
    '<div class="newsletter" data-rest>{}</div>', "<nav data-rest>{}</nav>", '<div class="cookie-notice" data-rest>{}</div>',
    '<section id="related" data-rest>{}</section>', "<footer data-rest>{}</footer>",
)


def composed(draw: random.Random) -> str:
    """A page drawn from the sentences: a main part with chrome inside and around it."""

    def links(n):
        return "<ul>" + "".join(f"<li><a href=x>{draw.choice(NAMES)}</a></li>" for _ in range(n)) + "</ul>"

    def beside():
        inner = draw.choice(("", "", links(draw.randint(2, 5))))
        for _ in range(draw.randint(1, 3)):
            inner += f"<p>{' '.join(draw.choice(ASIDES) for _ in range(draw.choice((1, 1, 2, 4))))}</p>"
        return draw.choice(_BESIDE).format(inner)

    def block():
        text = " ".join(draw.choice(SENTENCES) for _ in range(draw.choice((1, 1, 2, 4))))
        if draw.random() < 0.2:
            words = text.split()
            text = " ".join([words[0], f"<a href=x>{' '.join(words[1:3])}</a>", *words[3:]])
        return draw.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>")).format(text)

    parts = [f"<h1>{draw.choice(SENTENCES)}</h1>"]
    for _ in range(draw.randint(3, 8)):
        parts.append(block())
        if draw.random() < 0.25:
            parts.append(beside())
    page = [f"<header><a href=/>{draw.choice(NAMES)}</a></header>", f"<nav>{links(4)}</nav>", draw.choice(_WRAPS).format("".join(parts))]
    page += [beside() for _ in range(draw.randint(1, 4))]
    return "".join(page)


#: Pages composed for the labelled table, beside the written ones.
COMPOSED = 60


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table: one row per block of the labelled pages."""
    draw = random.Random(19)
    rows = []
    for page in (*LABELLED, *[composed(draw) for _ in range(COMPOSED)]):
        blocks = blocks_of(page)
        rows += [(*f, float(b.label)) for f, b in zip(described(blocks), blocks, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*FEATURES, "label"]))


def extracted(pages: DataFrame, keep=("page_id", "url")) -> DataFrame:
    """``keep``, the main ``text`` of every page, and ``n_chars``."""
    spark = pages.sparkSession
    tree = once(spark, "main text", lambda: fitted(labelled(spark), FEATURES, "label", 1, DEPTH))[0]

    def prepare():
        def one(raw: bytes) -> str:
            blocks = blocks_of(raw.decode())
            return " ".join(b.text for b, f in zip(blocks, described(blocks), strict=True) if predict(tree, f) > 0.5)

        return lambda texts: [pa.array([one(raw) for raw in texts], pa.string())]

    found = scan(pages, list(keep), [T.StructField("_main", T.StringType())], prepare, text="html")
    return found.select(*keep, F.col("_main").alias("text"), F.length("_main").cast("bigint").alias("n_chars"))
