"""Main text of web pages with site template removal.

Each page is parsed into a tree.  Every element's subtree is hashed; Spark counts on how many distinct pages of a
host each hash occurs.  Subtrees that recur on at least ``share`` of a host's pages (and ``least`` pages)
are its template and are deleted, except paragraphs and headings inside an article: a sentence that many
articles quote is still text.  Lists of links are hashed a second time without their texts (elements, classes, one
of each run of equal children): menus whose entries differ from page to page recur by that.  The page itself, its body
and main elements are never template, nor is an article unless another is left, nor what holds most of the text that
would be read: a story that many pages print is no template.  Elements that are no text by their kind
(navigation, scripts, forms and the like), by their role or by a name among their classes or id go as well; none
goes for a name, or for being a form or the like, that holds the only articles or most of the text.  What is left of
the articles of a page, or of its main elements, or of its body, is the text.

Pages are read in one pass over their tokens: a tag ends at the first ``>`` outside of a quoted value, and what is not ended
by the end of the page is dropped, as the HTML standard has it; end tags without an open element are skipped, and
elements nested deeper than ``DEEPEST`` are children of the one at that depth, so that broken pages take no longer than
others.  Character references are decoded, white space within a block becomes one space, and blocks are joined by
one space.  Null html counts as empty and gives an empty text; pages without a host have no template.  Repeated
rows give their text each and count as one page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm.common import map_batches, remove, save, sliced, small_batches, table

# Kinds of elements, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Elements that a start tag of the same group ends.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: Elements that such a start tag does not reach out of.
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
TABLE_FENCES = ("table",)
NO_TEXT = frozenset("head title nav footer aside form button select input dialog menu search object canvas audio video map fieldset datalist annotation annotation-xml".split())
#: Of NO_TEXT, those that some pages wrap around all that they hold.
WRAPPERS = frozenset("form fieldset dialog object".split())
#: Elements whose content is no markup, or none that is read.
UNREAD = frozenset("script style noscript template textarea iframe svg".split())
#: Elements of text, which go for their classes only if all of these are names of what is no text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
#: Characters of text, without spaces, that are a story and no menu or notice.
STORY = 300
#: Open elements at most.
DEEPEST = 512
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NO_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar "
    "aside widget related recommended share sharing social cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login "
    "comment comments reply replies respond disqus toolbar pagination pager skip".split()
)
#: Words that say nothing in the name of a class: "ad-box" is an ad, "has-sidebar" is no sidebar.
PLAIN_WORDS = frozenset("area bar bars block bottom box button buttons container content footer form global group header holder icons inner item items js left links list main outer page panel posts right row section site slot template the top unit wrap wrapper zone".split())
#: Of NO_TEXT_WORDS, those of what may hold articles of its own and still is no text.
SIDE_WORDS = frozenset("comment comments reply replies respond disqus related recommended ad ads adv advert adverts advertisement sponsored promo".split())
#: Elements that are a page's own even if they recur.
NEVER_TEMPLATE = frozenset(("#root", "html", "body", "main"))
#: Elements inside an article that are deleted as template; others there are text.
ARTICLE_TEMPLATE = frozenset("div section ul ol dl table figure details".split())

#: A tag: quotes count only after an equals sign.  Nothing is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?)*+)>")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in UNREAD}
_COMMENT = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([^\s=/][^\s=/]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s]++))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("children", "digest", "dropped", "look", "size", "skeleton", "tag", "words")

    def __init__(self, tag: str, dropped: bool, words: frozenset[str] = frozenset(), look: str = ""):
        """words: those by which it is dropped, of its class and id or its kind, if by nothing else; look: its classes."""
        self.tag, self.dropped, self.words, self.look = tag, dropped, words, look
        self.children: list = []
        self.digest = self.size = 0
        self.skeleton: int | None = None  # of a list of links


def _node(tag: str, source: str) -> Node:
    """The element of a tag; source: its attributes."""
    if tag in NO_TEXT:
        return Node(tag, True, frozenset((tag,)) if tag in WRAPPERS else frozenset())
    if not source or source.isspace() or tag in ("html", "body", "main"):
        return Node(tag, False)
    words: set[str] = set()
    other, look = False, []
    for name, value in _ATTRIBUTE.findall(source):
        name, value = name.lower(), value.strip("\"'") if value[:1] in "\"'" else value
        if name == "hidden" or (name == "role" and value.lower() in NO_TEXT_ROLES):
            return Node(tag, True)
        if name in ("class", "id"):
            for token in value.split():
                of = {w.lower() for w in _WORD.findall(token)}
                if of <= NO_TEXT_WORDS | PLAIN_WORDS:
                    words |= of & NO_TEXT_WORDS
                else:
                    other = True
                if name == "class":
                    look.append(token)
    if other and tag in PROSE:
        words = set()
    return Node(tag, bool(words), frozenset(words), " ".join(look))


def _keep_wrappers(root: Node) -> None:
    """Elements that are dropped for a word stay if no article or main element is left without them and they hold one, or most of the page's text."""
    order, todo = [], [(root, False)]
    while todo:
        node, under = todo.pop()
        under |= node.dropped
        if node.tag in ("article", "main") and not under:
            return
        order.append(node)
        todo += [(c, under) for c in node.children if c.__class__ is Node and (c.words or not c.dropped)]
    held: dict[int, tuple[int, bool]] = {}  # characters of text, and whether an article or main element is in it
    for node in reversed(order):
        size, article = 0, node.tag in ("article", "main")
        for child in node.children:
            if child.__class__ is not Node:
                size += len(child.strip())
            elif below := held.get(id(child)):
                size, article = size + below[0], article or below[1]
        held[id(node)] = size, article
    todo = [root]
    while todo:
        node = todo.pop()
        if node.words:
            size, article = held[id(node)]
            if size * 2 <= held[id(root)][0] and (not article or node.words & SIDE_WORDS):
                continue
            node.dropped, node.words = False, frozenset()
        todo += [c for c in node.children if c.__class__ is Node and (c.words or not c.dropped)]


def _skipped(page: str, tag: str, at: int) -> int:
    """The place after an element that isn't read, whose start tag ends at a place."""
    found = _ENDS[tag].search(page, at)
    if not found:
        return len(page)
    end = page.find(">", found.end())
    return len(page) if end < 0 else end + 1


def parse(page: str | None) -> Node:
    """The tree of a page; its text children are decoded."""
    page = page or ""
    root = Node("#root", False)
    stack, wrapped = [root], False
    open_: Counter[str] = Counter()
    at, size = 0, len(page)

    def close(k: int) -> None:
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    def text(end: int) -> None:
        part = page[at:end]
        stack[-1].children.append(entities.unescape(part) if "&" in part else part)

    look = 0
    while at < size:
        mark = page.find("<", look)
        if mark < 0 or mark + 1 == size:
            text(size)
            break
        sign = page[mark + 1]
        if not (sign.isascii() and sign.isalpha()) and sign not in "/!?":
            look = mark + 1
            continue
        if mark > at:
            text(mark)
        if page.startswith("<!--", mark):
            if page.startswith((">", "->"), mark + 4):
                at = look = page.index(">", mark) + 1
                continue
            end = _COMMENT.search(page, mark + 4)
            at = look = end.end() if end else size
            continue
        if sign in "!?" or (sign == "/" and not (mark + 2 < size and page[mark + 2].isascii() and page[mark + 2].isalpha())):
            end = page.find(">", mark)
            at = look = size if end < 0 else end + 1
            continue
        found = _TAG.match(page, mark)
        if not found:
            break
        at = look = found.end()
        tag, source = found[2].lower(), found[3]
        if found[1]:
            if open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag == "p" and stack[k].tag not in INLINE:
                        break
            continue
        if tag in UNREAD:
            stack[-1].children.append(" ")
            if not (tag == "svg" and source.endswith("/")):
                at = look = _skipped(page, tag, at)
            continue
        if tag in VOID:
            stack[-1].children.append(Node(tag, tag in NO_TEXT))
            continue
        if tag in CLOSES_P:
            if open_["p"] > 0:
                _end(stack, close, ("p",), ("article", "section", "div", "td", "th", "li", "button", "main", "body"))
        elif tag in SIBLINGS and any(open_[t] > 0 for t in SIBLINGS[tag]):
            _end(stack, close, SIBLINGS[tag], FENCES.get(tag, TABLE_FENCES))
        node = _node(tag, source)
        wrapped |= bool(node.words)
        stack[-1].children.append(node)
        if not source.endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
            open_[tag] += 1
    if wrapped:
        _keep_wrappers(root)
    return root


def _end(stack: list[Node], close: Callable[[int], None], tags: tuple[str, ...], fences: tuple[str, ...]) -> None:
    """Ends the outermost open element of tags that lies within the fences."""
    found = 0
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in fences:
            break
        if stack[k].tag in tags:
            found = k
    if found:
        close(found)


def _digest(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x02".join(parts)) - (1 << 63)


def digests(root: Node) -> list[int]:
    """Hashes every subtree, and returns the distinct hashes, with texts and of lists of links without, of those with text that can be template."""
    found = set()
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if c.__class__ is Node]
    inside: dict[int, tuple[int, int, str]] = {}  # links, characters in them, and the skeleton's text
    for node in reversed(order):
        parts, bones = [node.tag], [node.tag, node.look]
        links = linked = 0
        for child in node.children:
            if child.__class__ is Node:
                parts.append(f"\x00{child.digest}")
                node.size += child.size
                n, chars, bone = inside.pop(id(child))
                links, linked = links + n, linked + chars
                if bone != bones[-1]:
                    bones.append(bone)
            elif words := child.split():
                parts.append("\x01" + " ".join(words))
                node.size += sum(map(len, words))
        if node.tag == "a":
            links, linked = 1, node.size
        node.digest = _digest(parts)
        bone = f"\x00{_digest(bones)}"
        inside[id(node)] = links, linked, bone
        if node.size and node.tag not in NEVER_TEMPLATE and node.tag not in INLINE:
            found.add(node.digest)
            if links >= 3 and linked * 10 >= node.size * 7:
                node.skeleton = _digest(["links", bone])
                found.add(node.skeleton)
    return sorted(found)


def _contents(root: Node, template: frozenset[int]) -> list[Node]:
    """The outermost articles (those that don't recur, if there are any), or else the main elements, or else the whole page."""
    articles: list[Node] = []
    mains: list[Node] = []
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.dropped:
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main" and not inside:
            mains.append(node)
        todo += [(c, inside or node.tag == "main") for c in reversed(node.children) if c.__class__ is Node]
    return [x for x in articles if x.digest not in template] or articles or mains or [root]


def _recurs(node: Node, content: Node, template: frozenset[int]) -> bool:
    if node.tag in NEVER_TEMPLATE or node.tag in INLINE:  # a word in a sentence is no template
        return False
    if content.tag == "article":
        return node.digest in template and node.tag in ARTICLE_TEMPLATE
    return node.digest in template or node.skeleton in template


def _prose(node: Node) -> int:
    """Characters in paragraphs and the like."""
    size, todo = 0, [node]
    while todo:
        node = todo.pop()
        if node.tag in PROSE:
            size += node.size
        else:
            todo += [c for c in node.children if c.__class__ is Node]
    return size


def _is_bulk(content: Node, template: frozenset[int]) -> bool:
    """Whether most of the text that would be read recurs, and is a story: in an article, long, or for the most part in paragraphs."""
    gone = prose = 0
    kept = sum(len(c) - c.count(" ") for c in content.children if c.__class__ is not Node)
    todo = [c for c in content.children if c.__class__ is Node]
    while todo:
        node = todo.pop()
        if node.dropped or (node.tag == "header" and content.tag != "article"):
            continue
        if _recurs(node, content, template):
            if node.digest in template:  # menus are no story
                gone += node.size
                prose += _prose(node)
            continue
        for child in node.children:
            if child.__class__ is Node:
                todo.append(child)
            else:
                kept += sum(map(len, child.split()))
    return gone > kept and (content.tag == "article" or gone >= STORY or 2 * prose > gone)


def extract(root: Node, template: frozenset[int] = frozenset()) -> str:
    """The main text of a parsed page, without the subtrees in template (hashes; needs digests() first)."""
    out: list[str] = []
    for content in _contents(root, template):
        inside = content.tag == "article"
        own = template if template and not _is_bulk(content, template) else frozenset()
        todo: list = [content]
        while todo:
            node = todo.pop()
            if node.__class__ is not Node:
                out.append(node)
                continue
            if node is not content and (node.dropped or (node.tag == "header" and not inside) or (own and _recurs(node, content, own))):
                continue
            if node.tag not in INLINE:
                out.append(" ")
                todo.append(" ")
            todo += reversed(node.children)
    text = " ".join("".join(out).split())
    return text if text or not template else extract(root)


def host(url: str | None) -> str | None:
    try:
        return urlsplit(url).hostname if url else None
    except ValueError:
        return None


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        hosts, pages, lists = [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at := host(url):
                root = parse(page)
                lists.append(digests(root))
                hosts.append(at)
                pages.append(root.digest)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["host", "page", "digests"])


def _texts(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = []
            known: dict[int, frozenset[int]] = {}
            for page, template in zip(batch.column(len(names) - 1).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                root = parse(page)
                if template:
                    digests(root)
                    template = known.setdefault(hash(tuple(template)), frozenset(template))
                texts.append(extract(root, template or frozenset()))
            columns = batch.columns[: len(names) - 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*names[:-1], "text"])

    return run


@F.pandas_udf(T.StringType())
def _host_of(urls: pd.Series) -> pd.Series:
    return urls.map(host)


def templates(pages: DataFrame, share: float = 0.05, least: int = 8) -> DataFrame:
    """(host, template): the hashes of the subtrees that recur on many of a host's distinct pages.

    A host has at most 1 / share times as many as a page has elements, so that the arrays stay small.
    """
    found, path = save(small_batches(pages.select("url", "html")).mapInArrow(_subtrees, "host string, page long, digests array<long>"), "subtrees")
    once = found.groupBy("host", "page").agg(F.first("digests").alias("digests"))
    sizes = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counts = once.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    often = counts.join(sizes, "host").where(F.col("n") >= F.col("pages") * share)
    out, _ = save(often.groupBy("host").agg(F.sort_array(F.collect_list("digest")).alias("template")), "templates")
    remove(pages.sparkSession, path)
    return out


def extract_text(pages: DataFrame, share: float = 0.05, least: int = 8) -> DataFrame:
    """All columns of pages but html, and text, which replaces a column of that name."""
    pages = pages.drop("__host", "__template")
    found = templates(pages, share, least)
    keep = [c for c in pages.columns if c not in ("html", "text")]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], "html", _host_of("url").alias("__host"))
    rows = rows.join(found.toDF("__host", "__template"), "__host", "left").select(*[F.col(f"`{c}`") for c in keep], "html", "__template")
    schema = pages.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("text")).schema
    return map_batches(rows, _texts([*keep, "html"]), schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
