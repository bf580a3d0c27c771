"""Main text of web pages: flat text blocks, judged by their size and links and those of their neighbours.

A page is cut into blocks at block elements; a block keeps its text, its words, how many of them are linked, whether it is a
heading, and in what kind of place it stands (``PLACES``). Spark then describes each block by its own word count and link
density, its neighbours' and its place, and a decision tree trained on ``LABELLED``, a table of a few pages, says which stay.
The tree becomes one column expression, so that no block leaves its row. Only cutting a page up is Python.

Places come from open elements: navigation, footers, sidebars and reader comments (``STRONG``) hold no main text whatever is in
them; elements named like page furniture (``WEAK``) and forms may wrap an article: if nearly all of a page's text stands in
forms, or else in either, these count as none. ``article`` and ``main`` count if they hold half of the other text at least.

Edge cases: null and empty pages and pages without a main block have an empty text; unclosed comments, scripts and tags reach to
the end of the page, as in browsers; unknown references stay as they are, references to no character become U+FFFD; white space
is what Unicode calls so, no-break spaces included; repeated rows are treated alike; an empty table gives an empty result;
other columns pass through ``main_text``, but one that has its result's name is replaced.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches

NONE, FORM, WEAK, STRONG, MAIN = PLACES = range(5)

# Names of elements, and words in class, id and role attributes.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html"
    " legend li main menu nav object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
STRONG_ELEMENTS = frozenset("aside button dialog footer head menu nav object search select svg template".split())
FORM_ELEMENTS = frozenset("fieldset form".split())
STRONG_WORDS = frozenset("comment comments commentlist complementary contentinfo discussion disqus navigation replies reply respond".split())
WEAK_WORDS = frozenset(
    "ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs consent cookie cookies copyright footer form gdpr header login masthead menu modal nav"
    " navbar newsletter notice notices notification pager pagination popup promo promoted recommended related search share sharing sidebar signin signup social sponsor"
    " sponsored subscribe subscription toolbar widget widgets".split()
)

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
NAMED = re.compile(r"""(?:^|[\s/"'])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HUMP = re.compile("(?<=[a-z])(?=[A-Z])")
WORDS = re.compile("[a-z]+")

#: Pages with their blocks in order: place (``n`` none, ``o`` none, on a page with an article, ``w`` weak, ``s`` strong, ``m`` in an article; after ``h`` for
#: headings), words, ``/`` linked words, ``+`` for main text.
LABELLED = """
s6/6 w6 hm9+ m22+ m140+ m8+ m60+ s20
s30/30 s12 hm7+ m80/3+ m5+ m95+ w40/30 s25/10
s8/8 o9 hm12+ m1+ m300/12+ m45+ o30/2 o5/5 s14
o4/4 o11 hm6+ m70+ m3/3 m110/10+ m12/12 s9
s5/5 w12 hm10+ m35+ m18+ m2+ s16
n7/7 n12/12 hn8+ n60+ n85/4+ n130+ n9/9 n15/11 n8
n3 n20/20 hn5+ n42+ n6+ n77+ n55/2+ n6/6 n6/6 n12
s12/12 hn9+ n4 n120/6+ n64+ n33+ w60 w45 w52/3 s22/4
w15/15 n25+ n38+ n90+ n28+ w20/8 n10/2
n2/2 n2/2 n3/3 hn7+ n31+ n150/5+ n14+ n88+ n4/4 n11
s40/40 w8 w30 hn11+ n75+ hn4+ n96+ hn3+ n66/3+ w24/24 s30/6
n18/18 n6 n5 n9/3 n7/7
s9/9 hm8+ m3+ m2+ m5+ m1+ s12
s9/9 w5 m400+ s12
n200+
n5/5 n180/9+ n5/5
w22 n12/12 hn6+ n50+ n11+ n70+ n13+ n95+ n8/6 n16
s6/6 w9 hm9+ m25+ m6/2+ m40/8+ m90/30+ s15/2
o7 o60/55 hm10+ m130+ o44 o21/4 s8
s20/20 w3 w80 w65/4 hm5+ m52+ w33 s10
w70/2 w110 s90/3 hn10+ n48+ n140+ s60
s11/11 hm4+ m9+ m7+ m12+ w28 w19/1 s13
s10/10 hm9+ m55+ m4+
w7 hm6+ m30+ m21+ m2+
hm8+ m90+ m11+ m70+ m1+
s4/4 hm5+ m3+ m2+
o12/12 hm7+ m66+ m9+
n9/9 hn6+ n44+ n61+
n70+ n120+ n33+
"""
FEATURES = ("furniture", "article", "heading", "words", "density", "words_before", "density_before", "words_after", "density_after")
BLOCK = "text string, words int, linked int, place int, heading boolean"


@dataclass(frozen=True, slots=True)
class Place:
    strong: bool = False
    weak: bool = False
    form: bool = False
    main: bool = False

    def within(self, name: str, attributes: str) -> Place:
        """Inside an element that stands here."""
        words = set()
        if "=" in attributes and name not in ("html", "body"):
            words = {w for groups in NAMED.findall(attributes) for w in WORDS.findall(HUMP.sub(" ", "".join(groups)).lower())}
        if self.main:  # an article's own header holds its title
            words -= {"header"}
        strong = self.strong or name in STRONG_ELEMENTS or name == "header" and not self.main or not STRONG_WORDS.isdisjoint(words)
        if name in ("article", "main") or "articlebody" in words or {"article", "body"} <= words:
            return Place(strong, main=True)
        return Place(strong, self.weak or not WEAK_WORDS.isdisjoint(words), self.form or name in FORM_ELEMENTS, self.main)

    def kind(self) -> int:
        return STRONG if self.strong else WEAK if self.weak else FORM if self.form else MAIN if self.main else NONE


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    try:
        return references.unescape(text)
    except ValueError:  # a number of thousands of digits
        return references.unescape(re.sub("&#[0-9]{8,};?", "�", text))


class Cutter:
    """The blocks of one page, in ``found``: (text, words, linked words, place, heading)."""

    def __init__(self, page: str):
        self.found: list[tuple[str, int, int, int, bool]] = []
        self.open: list[tuple[str, Place]] = []
        self.counts: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.linked, self.link = 0, -1  # words in links so far; how many elements were open when the link began
        self._read(page)
        self._end_block()

    def _end_block(self) -> None:
        words = "".join(self.pieces).split()
        if words:
            place = self.open[-1][1] if self.open else Place()
            heading = any(name in HEADINGS for name, _ in self.open[-1:])
            self.found.append((" ".join(words), len(words), min(self.linked, len(words)), place.kind(), heading))
        self.pieces, self.linked = [], 0

    def _text(self, text: str) -> None:
        if text:
            text = _decoded(text)
            self.pieces.append(text)
            if self.link >= 0:
                self.linked += len(text.split())

    def _close(self, name: str) -> None:
        if self.counts[name]:
            last = ""
            while last != name:
                last = self.open.pop()[0]
                self.counts[last] -= 1
            if self.link > len(self.open):
                self.link = -1

    def _tag(self, end: str, name: str, attributes: str) -> None:
        if name == "a":
            self.link = -1 if end else len(self.open)
        elif name == "br":
            self.pieces.append(" ")
        elif name in BLOCKS:
            self._end_block()
            if end:
                self._close(name)
                return
            if self.open and self.open[-1][0] == "p":  # not always closed
                self._close("p")
            if name != "hr":
                self.open.append((name, (self.open[-1][1] if self.open else Place()).within(name, attributes)))
                self.counts[name] += 1

    def _read(self, page: str) -> None:
        at = start = 0
        while (lt := page.find("<", at)) >= 0:
            after = page[lt + 1 : lt + 2]
            letter = page[lt + 2 : lt + 3] if after == "/" else after
            if after and after in "!?" or after == "/" and not (letter.isascii() and letter.isalpha()):
                close = "-->" if page.startswith("<!--", lt) else ">"
                stop = page.find(close, lt + 2)
                self._text(page[start:lt])
                if stop < 0:
                    return
                at = start = stop + len(close)
            elif m := TAG.match(page, lt):
                self._text(page[start:lt])
                end, name = m[1], m[2].lower()
                at = start = m.end()
                if name in RAW and not end:
                    self._end_block()
                    done = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                    if not done:
                        return
                    at = start = done.end()
                else:
                    self._tag(end, name, m[3])
            elif letter.isascii() and letter.isalpha():  # a tag that never ends
                self._text(page[start:lt])
                return
            else:
                at = lt + 1
        self._text(page[start:])


def _blocks(col: pa.Array) -> pa.Array:
    every, ends = [], [0]
    for page in col.to_pylist():
        every += Cutter(page or "").found
        ends.append(len(every))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    cols = [pa.array([b[k] for b in every], kind) for k, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, names=["text", "words", "linked", "place", "heading"]))


def described(block: Column, before: Column, after: Column, furniture: Column, article: Column) -> dict[str, Column]:
    """What the tree looks at; ``before`` and ``after`` are null at the ends of a page."""
    words = lambda b: F.coalesce(b["words"], F.lit(0)).cast("double")
    density = lambda b: F.coalesce(b["linked"] / b["words"], F.lit(0.0))
    of = [furniture.cast("double"), article.cast("double"), block["heading"].cast("double"), words(block), density(block), words(before), density(before), words(after), density(after)]
    return dict(zip(FEATURES, of, strict=True))


def labelled(spark: SparkSession, text: str = LABELLED) -> DataFrame:
    """``FEATURES`` and ``label`` of each block of such a table."""
    rows = []
    for page, line in enumerate(text.split("\n")):
        for k, (heading, place, words, linked, main) in enumerate(re.findall(r"(h?)([nowsm])(\d+)(?:/(\d+))?(\+?)", line)):
            rows.append((page, k, int(place in "ws"), {"o": -1, "m": 1}.get(place, 0), (int(words), int(linked or 0), bool(heading)), float(bool(main))))
    df = spark.createDataFrame(rows, "page int, k int, furniture int, article int, block struct<words: int, linked: int, heading: boolean>, label double").coalesce(1)
    near = [F.expr(f"{f}(block) OVER (PARTITION BY page ORDER BY k)").alias(f) for f in ("lag", "lead")]
    df = df.select("*", *near)
    return df.select(*(c.alias(n) for n, c in described(F.col("block"), F.col("lag"), F.col("lead"), F.col("furniture"), F.col("article")).items()), "label")


def tree(table: DataFrame, depth: int = 6):
    """A decision tree that tells ``label`` from ``FEATURES``."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return DecisionTreeClassifier(maxDepth=depth, maxBins=256, seed=1).fit(data)


def as_column(model, features: dict[str, Column]) -> Column:
    """A tree's prediction as an expression."""

    def of(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(node.prediction() == 1)
        split = node.split()
        return F.when(features[FEATURES[split.featureIndex()]] <= split.threshold(), of(node.leftChild())).otherwise(of(node.rightChild()))

    return of(model._java_obj.rootNode())


def cut(pages: DataFrame, html: str = "html", result: str = "blocks") -> DataFrame:
    """``pages`` with their text blocks instead of ``html``."""
    small_batches(pages.sparkSession)
    names = [c for c in pages.columns if c not in (html, result)]
    (source,) = fresh(pages, "html")
    rows = pages.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{html}`").cast("string").alias(source))
    kind = T.StructType([*rows.schema.fields[:-1], T.StructField(result, T._parse_datatype_string(f"array<struct<{BLOCK}>>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _blocks(b.columns[-1])], names=[*names, result])

    return rows.mapInArrow(run, kind)


def main_text(pages: DataFrame, model=None, html: str = "html", result: str = "text") -> DataFrame:
    """``pages`` with the main text in ``result`` instead of ``html``."""
    model = model or tree(labelled(pages.sparkSession))
    (blocks,) = fresh(pages, "blocks")
    if result != html and result in pages.columns:
        pages = pages.drop(result)
    done = cut(pages, html, blocks)
    every = F.col(blocks)
    total = lambda *places: F.aggregate(F.filter(every, lambda b: b["place"].isin(*places)), F.lit(0).cast("long"), lambda n, b: n + b["words"])
    sums = F.struct(total(NONE).alias("none"), total(FORM).alias("form"), total(WEAK).alias("weak"), total(MAIN).alias("main"))

    def stays(s: Column, b: Column, i: Column) -> Column:
        in_form = s["form"] > 4 * (s["none"] + s["main"])
        plain = s["none"] + F.when(in_form, s["form"]).otherwise(0)
        in_weak = s["weak"] > 4 * (plain + s["main"])
        plain = plain + F.when(in_weak, s["weak"]).otherwise(0)
        article = F.when((s["main"] == 0) | (s["main"] < plain), 0).when(b["place"] == MAIN, 1).otherwise(-1)
        furniture = (b["place"] == STRONG) | (b["place"] == WEAK) & ~in_weak | (b["place"] == FORM) & ~in_form
        return as_column(model, described(b, F.get(every, i - 1), F.get(every, i + 1), furniture, article))

    # sums bound to a name once a page, not once a block
    kept = F.transform(F.array(sums), lambda s: F.filter(every, lambda b, i: stays(s, b, i)))[0]
    return done.withColumn(result, F.array_join(F.transform(kept, lambda b: b["text"]), " ")).drop(blocks)


def op12_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
