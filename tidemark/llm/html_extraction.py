"""Main text of web pages by deducing their sites' templates.

Pages of one host are made from a template with slots.  A page is a sequence of
tokens: tags, told apart by their path from the root, pieces of text, told
apart by path and words, and containers, told apart by path and place among
their like.  A token's occurrence vector says how often it occurs in each page
of the host; tokens with the same vector form an equivalence class, and classes
that are large and found in most pages belong to the template.  The containers
found once in each of these nest in one another by their paths and make the
template's tree; what the classes' text pieces leave of their text are its
slots.  From the root the tree is followed down to the innermost container that
holds most of the slots' text over all the host's pages: the article.  Hosts
whose template has article or main elements need no such search.  Names of
elements tell what within the article is no part of it (adverts, comments,
forms), and, where a host has no template, all there is to tell.

Vectors are never laid out: a token's is summed up by the exclusive or of
hashes of (page, count) over different pages, so classes come from an aggregate
over (host, token) and no task holds a host's pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, lean

#: A template's class is found in this share of a host's pages, and in this many pages, and has this many tokens.
SHARE, PAGES, TOKENS = 0.6, 5, 2
#: A container holds most of another's slots from this share of their text on.
MOST = 0.6
#: Kinds of tokens: text, tags, containers, containers that are an article or main element, and the parts of a text token in further containers.
TEXT, TAG, NODE, ARTICLE, PART = range(5)

#: HTML's elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Elements that hold no text of an article; whether one can lie in another of its name; those that "/>" closes.
HELD = frozenset("noscript template iframe svg math object canvas audio video select button".split())
NESTED = frozenset("template svg math object".split())
FOREIGN = frozenset("svg math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside dialog fieldset footer form head input label menu nav".split()) | RAW | HELD
MAIN = frozenset("article main".split())
CONTAINERS = frozenset("article body center dd div main section table tbody td tr".split())
#: Which open elements an opening tag ends, and where to stop looking for them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus feedback footer gdpr hidden legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets alert complementary contentinfo".split()
)
#: Those that do so only outside an article.
HEAD_WORDS = frozenset("header head topbar top site".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: An element of HELD that is never closed: it ends with its parent or at the next block.
LOOSE = "?"
_WORD = re.compile(r"[a-z0-9]+")


class Piece:
    """Text between two tags: its token, block number, whether it is dropped, in the article, and of a link, and the containers it is in."""

    __slots__ = ("token", "text", "block", "dropped", "main", "link", "nodes")

    def __init__(self, token: int, text: str, block: int, dropped: bool, main: bool, link: bool, nodes: tuple[int, ...]):
        self.token, self.text, self.block, self.dropped, self.main, self.link, self.nodes = token, text, block, dropped, main, link, nodes


class Node:
    """A container: its kind, the one it is in (0: none), and the characters of text in it that are neither dropped nor a link's."""

    __slots__ = ("kind", "parent", "mass")

    def __init__(self, kind: int, parent: int):
        self.kind, self.parent, self.mass = kind, parent, 0


def parse(page: str | None) -> tuple[list[int], list[Piece], dict[int, Node]]:
    """A page's tokens in order, its pieces of text, and its containers."""
    tokens: list[int] = []
    pieces: list[Piece] = []
    nodes: dict[int, Node] = {}
    like: Counter[str] = Counter()  # containers of a kind in their container so far
    # open elements: tag, path, dropped, main, link, containers
    stack: list[tuple[str, str, bool, bool, bool, tuple[int, ...]]] = [("", "", False, False, False, ())]
    block = at = 0
    last: set[str] = set()  # names of which no closing tag follows
    source = page or ""
    n = len(source)

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            words = html.unescape(raw)
            _, path, dropped, main, link, inside = stack[-1]
            plain = " ".join(words.split())
            token = xxhash.xxh64_intdigest(f"{path}\0{plain}")
            tokens.append(token)
            pieces.append(Piece(token, words, block, dropped, main, link, inside))
            if not dropped and not link:
                for node in inside:
                    nodes[node].mass += len(plain)
        elif raw and pieces and pieces[-1].block == block:
            pieces[-1].text += " "

    def closed(tag: str) -> bool:
        """Whether a closing tag follows, before the next of an element that can't lie in its like."""
        if tag in last:
            return False
        m = re.compile(rf"</{tag}\b" if tag in NESTED else rf"<(/?){tag}\b", re.I).search(source, at)
        if not m:
            last.add(tag)
        return bool(m) and (tag in NESTED or m[1] == "/")

    while at < n:
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        m = _TOKEN.match(source, start)
        if not m:
            # a "<" that begins no tag is text, up to the next one
            following = source.find("<", start + 1)
            following = n if following < 0 else following
            text(source[at:following])
            at = following
            continue
        text(source[at:start])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                block += not any(e[0] in HELD for e in stack)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in BLOCKS:
            block += not any(e[0] in HELD for e in stack)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or stack[k][0] == LOOSE:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS or stack[k][0] in HELD:
                    break
        if tag in ENDS:
            ended, stop = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stop or stack[k][0] in HELD:
                    break
                if stack[k][0] in ended:
                    del stack[k:]
                    break
        if tag == "br" and pieces and pieces[-1].block == block:
            pieces[-1].text += " "
        names = ""
        if m[3] and not m[3].isspace():
            given = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[3])}
            names = f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".lower()
        else:
            given = {}
        _, above, dropped, main, link, within = stack[-1]
        path = f"{above}/{tag}.{given['class']}" if given.get("class") else f"{above}/{tag}"
        tokens.append(xxhash.xxh64_intdigest(path))
        if tag in VOID:
            continue
        words = set(_WORD.findall(names)) if names else set()
        inside = main or tag in MAIN or "main" in given.get("role", "").lower().split() or given.get("itemprop", "").lower() == "articlebody"
        # a name such as "page has-sidebar" on the body or the article itself says what is in it, not what it is
        named = tag not in MAIN and tag not in ("html", "body") and bool(words & ASIDE_WORDS or not inside and words & HEAD_WORDS)
        off = dropped or tag in DROPPED or named or tag == "header" and not inside or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        off = off or tag in MAIN and bool(words & {"comment", "comments", "reply", "replies", "related", "sidebar", "ad", "advert", "advertisement"})
        if tag in RAW:
            # content without markup, or whose markup is no text: skip to its end
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = closing.end() if closing else n
            continue
        if tag in FOREIGN and m[3].endswith("/"):
            continue
        if tag in CONTAINERS and not off:
            parent = within[-1] if within else 0
            kind = f"{parent}/{tag}.{given.get('class', '')}"
            like[kind] += 1
            node = xxhash.xxh64_intdigest(f"{kind}#{like[kind]}")
            nodes[node] = Node(ARTICLE if tag in MAIN else NODE, parent)
            within = (*within, node)
        stack.append((LOOSE if tag in HELD and not closed(tag) else tag, path, off, inside, link or tag == "a", within))
    return tokens, pieces, nodes


class Template:
    """A host's: for tokens of text and tags their class, their mean place in a page and how often a page that has them does on average; and the container that is the article, if one is."""

    def __init__(self, rows: list[dict]):
        self.tokens = {r["token"] & _ALL: (r["of"], r["place"], r["times"]) for r in rows if r["kind"] < NODE}
        # the tree: containers that come once in each page that has them, and the text in them that the template leaves to slots
        nodes = {r["token"] & _ALL: r for r in rows if r["kind"] in (NODE, ARTICLE)}
        mass = {t: r["mass"] for t, r in nodes.items()}
        for r in rows:
            if r["kind"] in (TEXT, PART):
                at = r["parent"] & _ALL
                while at in nodes:
                    mass[at] -= r["mass"]
                    at = nodes[at]["parent"] & _ALL
        self.article = None
        if any(r["kind"] == ARTICLE for r in nodes.values()):
            return
        under: dict[int, list[int]] = {}
        for t, r in nodes.items():
            under.setdefault(r["parent"] & _ALL, []).append(t)
        at = max(under.get(0, ()), key=lambda t: (mass[t], t), default=None)
        root = at
        while at is not None and mass[at] > 0:
            best = max(under.get(at, ()), key=lambda t: (mass[t], t), default=None)
            if best is None or mass[best] < MOST * mass[at]:
                break
            at = best
        # the root itself tells nothing
        if at != root:
            self.article = at


def main_text(page: str | None, template: Template | None = None) -> str:
    """The article's blocks, joined by two newlines; '' if there is none.

    A token counts as the template's where it comes in its class's order, which
    begins again as often as the class comes in a page; text pieces that do are
    no slots, except in an article or main element, where names alone tell what
    to drop.  Of the slots those in the template's article are kept; on a page
    that lacks it, and without a template, those that names don't mark.
    """
    tokens, pieces, nodes = parse(page)
    known = template.tokens if template else {}
    if template and template.article in nodes and not any(p.main and not p.dropped for p in pieces):
        pieces = [p for p in pieces if template.article in p.nodes]
    reached: dict[int, float] = {}
    begun: Counter[int] = Counter()  # repetitions of a class after its first
    fixed: Counter[int] = Counter()
    for t in tokens:
        if t in known:
            of, place, times = known[t]
            if place < reached.get(of, -1.0) and begun[of] + 1 < times:
                begun[of] += 1
                reached[of] = -1.0
            if place >= reached.get(of, -1.0):
                reached[of] = place
                fixed[t] += 1
    free: set[int] = set()  # blocks with a slot: words of the template within them belong to their sentences
    for p in pieces:
        if fixed[p.token]:
            fixed[p.token] -= 1
            # what an article holds is its own, on however many pages it stands
            template_only = not p.main
        else:
            template_only = False
        if not template_only and not p.dropped:
            free.add(p.block)
    slots = [p for p in pieces if p.block in free and not p.dropped]
    if any(p.main for p in slots):
        slots = [p for p in slots if p.main]
        by_links = False
    else:
        by_links = True
    blocks: dict[int, list[Piece]] = {}
    for p in slots:
        blocks.setdefault(p.block, []).append(p)
    out = []
    for own in blocks.values():
        words = " ".join("".join(p.text for p in own).split())
        linked = sum(len(p.text) for p in own if p.link)
        if words and not (by_links and linked > 0.6 * sum(len(p.text) for p in own)):
            out.append(words)
    return "\n\n".join(out)


_MIX = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


_FOUND = "host long, token long, pages long, vector long, place long, times long, kind long, parent long, mass long"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each batch's pages, those of one host put together; token 0 stands for the page."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    for batch in batches:
        found: dict[tuple[int, int], list[int]] = {}
        for host, key, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            tokens, pieces, nodes = parse(page)
            first: dict[int, int] = {}
            for k, t in enumerate(tokens):
                first.setdefault(t, k)
            texts: dict[int, dict[int, int]] = {}
            for p in pieces:
                own, at = texts.setdefault(p.token, {}), p.nodes[-1] if p.nodes else 0
                own[at] = own.get(at, 0) + (0 if p.dropped or p.link else len(" ".join(p.text.split())))
            rows = [(t, n, first[t], *((TEXT, *next(iter(texts[t].items()))) if t in texts else (TAG, 0, 0))) for t, n in Counter(tokens).items()]
            rows += [((t * _MIX ^ at) & _ALL, 1, 0, PART, at, mass) for t, own in texts.items() for at, mass in list(own.items())[1:]]
            rows += [(t, 1, 0, node.kind, node.parent, node.mass) for t, node in nodes.items()]
            for t, n, place, kind, parent, mass in rows:
                v = ((key ^ (n * _MIX)) * 0xBF58476D1CE4E5B9) & _ALL
                v ^= v >> 31
                row = found.get((host, t))
                if row is None:
                    found[host, t] = [1, v, place, n, kind, parent, mass]
                else:
                    row[0] += 1
                    row[1] ^= v
                    row[2] += place
                    row[3] += n
                    row[6] += mass
            row = found.setdefault((host, 0), [0] * 7)
            row[0] += 1
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        rows = list(zip(*found.values(), strict=True)) if found else [()] * 7
        own = [pa.array(rows[i], pa.int64()) if i not in (1, 5) else signed(rows[i]) for i in range(7)]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), signed([t for _, t in found]), *own], names)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, Template] = {}  # templates of the hosts met in this batch
    for batch in batches:
        texts = []
        known.clear()
        hosts, pages, found = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
        for k, (host, page) in enumerate(zip(hosts, pages, strict=True)):
            if host not in known:
                known[host] = Template(found[k].as_py() or [])
            texts.append(main_text(page, known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def templates(pages: DataFrame, stage: Stage, share: float = SHARE, least: int = PAGES, size: int = TOKENS) -> DataFrame:
    """(host, found): for each host with a template, its tokens with their class, mean place, kind, container and text."""
    # copies of a page are one: however many a host has, they say nothing of its template
    pages = pages.groupBy("host", "key").agg(F.first("html").alias("html"))
    found = pages.mapInArrow(lean(_occurrences), _FOUND)
    found = found.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), (F.sum("place") / F.sum("pages")).alias("place"), (F.sum("times") / F.sum("pages")).alias("times"),
        F.first("kind").alias("kind"), F.first("parent").alias("parent"), F.sum("mass").alias("mass"),
    )
    found = stage.write(found.where(F.col("pages") >= least))
    total = found.where("token = 0").select("host", F.col("pages").alias("of_pages"))
    frequent = found.where("token <> 0").join(total, "host").where(F.col("pages") >= share * F.col("of_pages"))
    token = F.struct("token", "place", "times", "kind", "parent", "mass")
    classes = frequent.groupBy("host", "vector", "pages").agg(F.collect_list(token).alias("tokens"))
    # a container is told by its place, so one alone is enough; of text and tags a valid class has several
    several = F.size(F.filter("tokens", lambda t: t["kind"] < NODE)) >= size
    classes = classes.withColumn("tokens", F.when(several, F.col("tokens")).otherwise(F.filter("tokens", lambda t: t["kind"] >= NODE)))
    # a host's template has as many tokens as 1 / share of its average page at most
    flat = classes.select("host", F.explode(F.transform("tokens", lambda t: t.withField("of", F.col("vector")))).alias("t"))
    found = stage.write(flat.groupBy("host").agg(F.collect_list("t").alias("found")))
    return found


def extract_text(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of ``pages`` (page_id, url, html; other columns are ignored).

    Null and empty html, and pages without an article, have text ''.  A page
    without a host in its url belongs to the host ''.  Hosts with fewer than
    ``least`` different pages have no template: elements' names alone decide.
    Where an article or main element holds text, only what is in it is kept;
    else the slots in the template's article, or all slots, without blocks that
    are mostly links.  Rows that repeat a page are each returned, with equal
    texts, and count once in the template.  Pages are read whole, however long.
    An empty table gives no rows.
    """
    stage = Stage(pages.sparkSession, "html-extraction")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"//([^/:?#]+)", 1), F.lit("")))
    keyed = pages.select("page_id", "url", "html", F.xxhash64(host).alias("host"), F.xxhash64("html").bitwiseAND(0x7FFFFFFFFFFFFFFF).alias("key"))
    template = templates(keyed, stage, share, least)
    # templates were written, so their size is known: broadcast only if under Spark's threshold, else shuffled
    both = keyed.join(template, "host", "left").select(F.col("page_id").cast("long"), "url", "host", "html", "found")
    return both.mapInArrow(lean(_extracted), "page_id long, url string, text string, n_chars long")
