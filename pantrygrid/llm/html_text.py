"""Main text of web pages: flat text blocks, classified by a decision tree over them and their neighbours.

A page is cut into blocks at block-level tags. A block has its text, its words, its words inside links, and what encloses
it. The tree is Spark ML's, trained on a small labelled table of blocks (from generated pages whose parts are known); it
sees word count and link density of a block and of the ones before and after it, and the enclosing elements (outside: the
page has a main container, and the block is not in it). The trained
tree becomes a Column expression over the page's array of blocks, so pages are never split over rows or shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrygrid.llm import shared

#: Elements that end a block, that are not text, that hold a page's main part, and that hold its surroundings.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
SILENT = set("head title script style noscript template iframe object svg math canvas audio video textarea datalist".split())
RAW = set("script style title textarea noscript iframe".split())
MAIN = {"article", "main"}
AROUND = set("nav header footer aside form menu dialog button select fieldset search".split())
HINTS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side widget cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation topbar toolbar footer header masthead copyright legal search pagination pager".split())
CONSENT = set("cookie cookies consent gdpr".split())
TALK = set("comment comments commentlist disqus discussion replies reply respond responses reviews".split())
#: What a head holds (anything else ends it), elements without content, and foreign ones, which a slash closes.
IN_HEAD = set("base basefont bgsound link meta title script style noscript template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag is often left out: their class words hold for the block that follows.
_LOOSE = set("p li dt dd option tr td th".split())
_TRACKED = (BLOCK | SILENT | {"button"}) - _LOOSE - VOID - {"body", "html"}
#: A quote opens a value only behind an equals sign. Quantifiers never give back, so that no tag costs more than its length.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</[^a-zA-Z>][^>]*+>?|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLE_MAIN = re.compile(r"(?:^|\s)role\s*=\s*[\"']?\s*main\s*(?:[\"'\s/>]|$)", re.I)
_LABEL = re.compile(r"data-label=\"(\d)\"")
_SPLIT = re.compile(r"[^a-z0-9]+")
_FIELDS = "text string, words int, linked int, main int, around int, hint int, talk int, heading int, label int, consent int"
#: What the tree sees of a block; of the two neighbours it sees the first two.
FEATURES = ["words", "density", "before_words", "before_density", "after_words", "after_density", "main", "around", "hint", "talk", "heading", "outside"]


def _class_words(attributes: str) -> set[str]:
    return set(_SPLIT.split(" ".join(x for t in _NAMES.findall(attributes) for x in t if x).lower())) if "=" in attributes else set()


def _is_comment(attributes: str) -> bool:
    """Whether a whole name of an element's classes, or its id, says that it is a comment: comment or comment-7, not comments-open."""
    names = {n for t in _NAMES.findall(attributes) for x in t if x for n in x.lower().split()} if "=" in attributes else set()
    return any(n in TALK or n.startswith(("comment-", "comment_", "reply-", "reply_")) for n in names)


def blocks(page: str) -> list[tuple]:
    """The text blocks of a page in order, as tuples of _FIELDS."""
    out: list[tuple] = []
    stack: list[tuple[str, int, int, int, int, int, int]] = []  # tag, main, around, hint, talk, label, consent
    open_: Counter[str] = Counter()  # tags on the stack
    silent, links, heading = 0, 0, 0
    said: set[str] = set()  # class words of the open element whose end tag may be left out
    parts: list[str] = []
    linked: list[str] = []

    def flush():
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                main, around, hint, talk, label, consent = stack[-1][1:] if stack else (0, 0, 0, 0, -1, 0)
                out.append((" ".join(words), len(words), min(len(words), len(html.unescape(" ".join(linked)).split())), main, around, int(hint or bool(said & HINTS)), int(talk or bool(said & TALK)), heading, label, int(consent or bool(said & CONSENT))))
            parts.clear()
            linked.clear()

    def text(piece: str):
        if piece and not silent:
            parts.append(piece)
            if links:
                linked.append(piece)

    def close(name: str):
        nonlocal silent
        while open_[name]:
            gone = stack.pop()[0]
            open_[gone] -= 1
            silent -= gone in SILENT
            if gone == name:
                break

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if open_["head"] and stack[-1][0] == "head" and piece.strip():
            close("head")
        text(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                flush()
                heading, said = 0, set()
            if name == "a":
                links = 0
            close(name)
            continue
        if open_["head"] and name not in IN_HEAD and name != "head":
            close("head")  # its end tag may be left out
        if name in BLOCK and (open_["svg"] or open_["math"]):
            close("svg")
            close("math")
        if name in BLOCK:
            flush()
            heading, said = int(len(name) == 2 and name[0] == "h" and name[1] in "123456"), set()
        elif name == "br":
            text(" ")
        attributes = m[3]
        if name == "a":
            links = 1
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(page, at)
            at = end.end() if end else size
        elif name in _LOOSE:
            said = _class_words(attributes)
        elif name in _TRACKED and not (name in SILENT and attributes.endswith("/")):
            above = stack[-1] if stack else ("", 0, 0, 0, 0, -1, 0)
            words = _class_words(attributes)
            around, hint, talk = int(above[2] or name in AROUND), int(above[3] or bool(words & HINTS)), int(above[4] or bool(words & TALK))
            holds = name in MAIN and not (name == "article" and (above[4] or _is_comment(attributes))) or "=" in attributes and bool(_ROLE_MAIN.search(attributes))
            consent = int(above[6] or bool(words & CONSENT))
            if holds and not above[1]:
                hint, talk, consent = 0, above[4], 0  # class words tell nothing against a page's main container, unless it is a comment
            label = _LABEL.search(attributes)
            stack.append((name, int(above[1] or holds), around, hint, talk, int(label[1]) if label else above[5], consent))
            open_[name] += 1
            silent += name in SILENT
    flush()
    return out


def with_blocks(pages: DataFrame, html_col: str) -> DataFrame:
    """pages with the column blocks, each with density and its neighbours' word counts and densities."""
    made = F.pandas_udf(lambda s: pd.Series([blocks(x) for x in s]), f"array<struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>>")
    got = pages.withColumn("blocks", made(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))
    near = lambda i, f: F.coalesce(F.when((i >= 0) & (i < F.size("blocks")), F.get("blocks", i)[f]).cast("double"), F.lit(0.0))
    rate = lambda i: near(i, "linked") / F.greatest(near(i, "words"), F.lit(1.0))
    full = F.transform(
        "blocks",
        lambda b, i: F.struct(
            b["text"].alias("text"),
            b["label"].alias("label"),
            near(i, "words").alias("words"),
            rate(i).alias("density"),
            near(i - 1, "words").alias("before_words"),
            rate(i - 1).alias("before_density"),
            near(i + 1, "words").alias("after_words"),
            rate(i + 1).alias("after_density"),
            *[b[f].cast("double").alias(f) for f in ("main", "around", "hint", "talk", "heading")],
            b["consent"].alias("consent"),
            (F.exists("blocks", lambda x: x["main"] > 0) & (b["main"] == 0)).cast("double").alias("outside"),
        ),
    )
    return got.withColumn("blocks", full)


def labelled_pages(n: int = 360) -> list[tuple[int, str]]:
    """The small labelled table: pages put together from parts that are known to be main text (data-label 1) or not (0).

    Two of three have a main container. In the others text of any length stands in plain divs, now and then with a class
    word that speaks against it, and what surrounds it often has no class: there, words and links must tell.
    """
    words = "rain fell on the quiet harbour while boats came home and people talked about bread prices near old stone walls".split()
    say = lambda n, k: " ".join(words[(i * 7 + k) % len(words)] for i in range(n)).capitalize() + "."
    links = lambda n, k: "".join(f'<li><a href="/{i}">{say(1 + (i + k) % 3, i)}</a></li>' for i in range(n))
    off = lambda tag, inner: f'<{tag} data-label="0">{inner}</{tag.split()[0]}>'
    out = []
    for k in range(n):
        has_main, tag, r = k % 3 != 2, ("article", "main")[k % 2], k // 3
        many = 1 + r % 6
        sizes = [(3, 8, 25, 60, 120, 14, 200)[(r + i * (1 + r % 5)) % 7] for i in range(many)]
        if not has_main:
            sizes = [max(x, 25) if i % 3 == 0 else x for i, x in enumerate(sizes)]
        body = f"<h1>{say(2 + r % 23, k)}</h1>" + "".join(f"<h2>{say(2 + i, k)}</h2>" * (i == 3) + f"<p>{say(x, i + k)}</p>" for i, x in enumerate(sizes))
        if r % 5 == 1:
            body += f'<p>{say(12, k)} <a href="/x">{say(3, k)}</a> {say(14, k + 1)}</p>'
        if r % 4 == 2:
            body += f"<ul><li>{say(4 + r % 9, k)}</li><li>{say(9, k)}</li></ul><p>{say(30, k)}</p>"
        if has_main and r % 7 == 3:
            body += f'<p><a href="/x">{say(1 + r % 12, k)}</a></p>'
        inner = [off('div class="ad"', say(6 + r % 90, k)), off('div class="share"', say(3, k)), off("aside", f"<p>{say(20 + r % 80, k)}</p>"), off('section id="comments"', f"<p>{say(10 + r % 90, k)}</p><p>{say(30, k)}</p>"), off("form", f"<p>{say(8, k)}</p>"), off("footer", say(9 + r % 20, k)), off("header", say(5, k)), "", off('div class="related"', f"<ul>{links(5, k)}</ul>"), off("nav", f"<ul>{links(3, k)}</ul>")][r % 10]
        top = [off("nav", f"<ul>{links(6, k)}</ul>"), off("header", f"<p>{say(4, k)}</p><ul>{links(5, k)}</ul>"), off('div class="menu"', f"<ul>{links(7, k)}</ul>"), off("div", f"<ul>{links(8, k)}</ul>"), off("div", f"<p>{say(3, k)}</p><p><a href='/'>{say(4, k)}</a> {say(1, k)}</p>"), ""][r % 6]
        note = [off('div class="cookie-notice"', say(14 + r % 60, k)), off('div class="ad"', say(4 + r % 40, k)), ""][r % 3]
        low = [off("footer", f"&copy; {say(6 + r % 25, k)}"), off('div class="comments"', f"<p>{say(25 + r % 60, k)}</p><p>{say(50, k + 2)}</p>") + off("footer", say(5, k)), off('aside class="sidebar"', f"<p>{say(12 + r % 50, k)}</p><ul>{links(4, k)}</ul>"), off("div", f"<p>{say(3, k)}</p><ul>{links(5, k)}</ul><p>{say(4, k)}</p>"), off("form", f"<p>{say(7, k)}</p>"), off("div", f"<p><a href='/'>{say(9, k)}</a></p><p><a href='/'>{say(14, k)}</a></p>"), ""][r % 7]
        if r % 9 == 4:  # a page with nothing but its text
            top, note, low, inner = "", "", "", ""
            body = body if r % 2 else f"<p>{say(1 + r % 40, k)}</p>"
        marked = ' class="post search"' * (not has_main and r % 6 == 1)
        open_tag, close_tag = (f'<{tag} data-label="1">', f"</{tag}>") if has_main else (f'<div{marked} data-label="1">', "</div>")
        out.append((k, f"<html><head><title>{say(4, k)}</title></head><body>{top}{note}{open_tag}{body}{inner if has_main else ''}{close_tag}{low}</body></html>"))
    return out


def fit_tree(spark: SparkSession, table: list[tuple[int, str]] | None = None, depth: int = 8):
    """Spark ML's decision tree over the labelled table."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    pages = spark.createDataFrame(table or labelled_pages(), "id long, html string").coalesce(1)
    rows = with_blocks(pages, "html").select(F.explode("blocks").alias("b")).select("b.*").where("label >= 0")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows.withColumn("label", F.col("label").cast("double")))
    return DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=depth, minInstancesPerNode=2, seed=7).fit(rows.select("x", "label"))


def tree_column(model, block: Column) -> Column:
    """The tree's decision on a struct with FEATURES, as a Column expression."""

    def walk(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(node.prediction() > 0.5)
        split = node.split()
        return F.when(block[FEATURES[split.featureIndex()]] <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(model._java_obj.rootNode())


def is_main(model, block: Column) -> Column:
    """What the tree says, but for two kinds of block: inside the main container one leaves only by a sign of its own or around it, however short or linked it is, and outside of it what asks for consent never stays."""
    inside = block["main"] > 0
    signs = (block["around"] > 0) | (block["hint"] > 0) | (block["talk"] > 0)
    return F.when(inside & ~signs, F.lit(True)).when(~inside & (block["consent"] > 0), F.lit(False)).otherwise(tree_column(model, block))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", table: list[tuple[int, str]] | None = None) -> DataFrame:
    """One row for every row of pages: id_col, url_col, text, n_chars, n_blocks.

    text is the page's main blocks, joined by line breaks: character references decoded, white space inside a block one
    space, a block trimmed. A null or empty page, and one without main text, has an empty text. Broken markup is read as
    far as it goes: a tag that never ends is dropped, an element that never ends lasts until its parent does. A null id
    or url stays null; repeated rows each give a row; an empty table gives an empty result; other columns are not read.
    table: labelled pages (id, html with data-label) to train on instead of the built-in ones.
    """
    spark = pages.sparkSession
    shared.small_batches(spark)
    model = fit_tree(spark, table)
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kept = F.transform(F.filter("blocks", lambda b: is_main(model, b)), lambda b: b["text"])
    out = with_blocks(own, "html").select("id", "url", F.size("blocks").alias("n_blocks"), F.array_join(kept, "\n").alias("text"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
