"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its containers, each by its path of elements with class and
id, and its blocks of text, each by its container and wording. Over the pages of
a host a token has an occurrence vector (its count in every page), kept as a sum
of page hashes that aggregates without gathering pages. Tokens with equal
vectors form an equivalence class. A class is valid if it holds in at least
``LEAST_SHARE`` of the host's pages, once a page, and nests: all its tokens lie
in one slot of the class around it. The valid classes, nested, are the host's
template; a block of text in most pages of its container, beside different
contents, is template text.

What is left between the template's tokens are the slots. From the root the
slots are followed down to the one that holds the data: text that is neither
template nor link. It is left as soon as text or a main heading would be lost.
A host of several layouts has a class, and so a slot, for each. ``article`` and
``main`` count ``PREFERRED`` times (a tie-break: with less than about half of a
page's data they aren't taken), and menus, headers, footers, sidebars, notices,
adverts, forms and comments are known by element, role or name, as no count
tells reader comments from an article. Only containers are judged by name,
never paragraphs: by the last part of a name that isn't only a place, whatever
it says of content besides, so ``post-comments`` go and ``social-impact``
stays. Names that are subjects too (a menu, related work, reactions) count
outside of ``article`` and ``main`` alone, or with links for most of their text.

A page whose host has no template (one page, or other containers than the rest)
is its own template. Containers nest by their paths; the order of siblings isn't
tested, as the slots are taken in page order whatever it is.
Repeated text within the slot is dropped only outside of ``article`` and ``main``
and where it is less than half, so that copies of an article on one host, and
passages that many articles share, keep their text. A host's valid tokens
are at most 1 / LEAST_SHARE times the mean number of tokens of a page, so its
template is one bounded row, joined back by host.

Text: character references decoded, white space inside a block to one space,
trimmed, blocks joined by two line feeds. Defined results: null or empty html
gives the empty text; null urls share one host; repeated rows keep a row each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.session import cut

#: Hosts and template tokens that are broadcast at most; more are joined by shuffling.
MAX_BROADCAST_HOSTS, MAX_BROADCAST_TOKENS = 20_000, 500_000
#: Share of a host's pages that a class must hold in, of a container's pages that template text must be in, and different contents beside it.
LEAST_SHARE, TEXT_SHARE, LEAST_CONTENTS = 0.1, 0.5, 3
#: A slot is followed down while it keeps this share of the data.
DOMINANT, PREFERRED = 0.9, 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas select xmp".split())
PARAGRAPHS = frozenset("p li h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html main menu nav ol pre section summary table tbody td tfoot th thead tr ul button head".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: What a container is called that is no part of an article; whatever else its name says of content.
STRANGE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored promo promos banner banners nav navbar breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar cookie cookies consent gdpr "
    "notice notices notification notifications alert alerts popup modal overlay newsletter subscribe signup login social share shares sharing comment comments commenting respond disqus reply replies toolbar pagination pager skiplink siteheader pageheader".split()
)
#: Names that are subjects too: they count outside of ``article`` and ``main``, and where at least LINKED of the text is links.
DOUBTFUL = frozenset("menu navigation related recommended recommendations reactions promotion promotions subscription rail".split())
#: Parts of a name that say where or how something stands, but not what it is.
PLACED = frozenset(
    "area article bar block body bottom box btn button buttons center col column container content count counter custom entry footer group header heading holder icon icons inner item items label left link links list main meta outer page panel post primary region right row secondary section "
    "section single site slot small story strip text title top unit view wrap wrapper".split()
) - {"footer"}
#: Names that begin so tell of what is elsewhere.
MODIFIERS = frozenset("no has with without hide show is non not".split())
COMMENTS = frozenset("comment comments reply replies".split())
LINKED = 0.5
PART = re.compile(r"[-_:.]+|(?<=[a-z])(?=[A-Z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def meant(name: str) -> str:
    """What a class or id calls its element: ``strange``, ``doubtful`` or nothing. The last part that isn't only a place decides: ``post-comments`` are comments, ``social-impact`` is an impact."""
    parts = [p.lower().rstrip("0123456789") for p in PART.split(name)]
    parts = [p for p in parts if p]
    if not parts or parts[0] in MODIFIERS:
        return ""
    for k in range(len(parts) - 1, 0, -1):
        if parts[k - 1] + parts[k] in STRANGE:  # side-bar, page-header
            parts[k - 1 : k + 1] = [parts[k - 1] + parts[k]]
            break
    while parts and parts[-1] in PLACED:
        parts.pop()
    return "" if not parts else "strange" if parts[-1] in STRANGE else "doubtful" if parts[-1] in DOUBTFUL else ""


@lru_cache(maxsize=4096)
def judged(tag: str, attributes: str) -> tuple[str, bool, bool, str]:
    """(label, hidden, boilerplate by element or role, what its names say) of a start tag."""
    names = {m[1].lower(): (m[2] or m[3] or m[4] or "").strip() for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    label = tag + "".join(f".{c}" for c in sorted(names.get("class", "").split())) + (f"#{names['id']}" if names.get("id") else "")
    hidden = "hidden" in names or names.get("aria-hidden") == "true" or bool(HIDDEN.search(names.get("style", "")))
    called = f"{names.get('class', '')} {names.get('id', '')}".split()
    if tag == "article":
        said = "strange" if any(COMMENTS & {p.lower() for p in PART.split(c)} and meant(c) for c in called) else ""
    else:
        said = "" if tag in ("main", "body", "html") else max(map(meant, called), key=["", "doubtful", "strange"].index, default="")
    return label, hidden, tag in BOILERPLATE or names.get("role", "").lower() in ROLES, said


def mixed(parent: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


class Page:
    """One pass over a page, linear in its length: its containers and its blocks of text (without boilerplate) in order."""

    def __init__(self, html: str):
        self.tags, self.labels, self.parents, self.paths = [""], [""], [-1], [0]
        self.blocks: list[tuple[int, str, int, bool]] = []  # container, text, characters in links, whether it is a main heading
        self.named: list[tuple[int, str, bool]] = []  # container, what its names say, whether it is within article or main
        self.open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # element, container, excluded, within article or main
        self.many: Counter = Counter()  # open elements by name, so that a stray end tag costs nothing
        self.words: list[str] = []
        self.link = self.linked = 0
        self.head = False
        at = 0
        for token in TOKEN.finditer(html):
            if token.start() < at:
                continue
            self.text(html[at : token.start()])
            at = token.end()
            if not (tag := (token[2] or "").lower()):
                continue
            if token[1]:
                self.end(tag)
            elif tag in RAW and not token[3].endswith("/"):
                # the raw text ends at its own end tag, whatever looks like a tag or comment before it
                stop = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(html, at)
                at = stop.start() if stop else len(html)
            else:
                self.start(tag, token[3])
        self.text(html[at:])
        self.flush()
        if self.named:
            self.drop_named()

    def drop_named(self) -> None:
        """Takes out the blocks of containers that are boilerplate by name.

        A container around ``main`` or a main heading never is. One of a doubtful name is if it stands outside of the page's ``article`` or ``main``, or
        holds mostly links.
        """
        sums, framed = self.sums(), any(t in ("article", "main") for t in self.tags)
        around = [t == "main" for t in self.tags]
        for node in range(len(around) - 1, 0, -1):
            around[self.parents[node]] |= around[node]
        gone = [False] * len(self.tags)
        for node, said, inside in self.named:
            chars, linked, heads = sums[node]
            gone[node] = not (around[node] or heads) and (said == "strange" or (framed and not inside) or linked >= LINKED * max(chars, 1))
        for node in range(1, len(gone)):
            gone[node] |= gone[self.parents[node]]
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def text(self, text: str) -> None:
        if text and not self.open[-1][2]:
            words = unescape(text)
            self.words.append(words)
            if self.link:
                self.linked += len(words.strip())

    def flush(self) -> None:
        if self.words:
            if block := " ".join("".join(self.words).split()):
                self.blocks.append((self.open[-1][1], block, min(self.linked, len(block)), self.head))
            self.words, self.linked, self.head = [], 0, False

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if tag in VOID or attributes.endswith("/"):
            if tag == "hr":
                self.flush()
            return
        if tag == "a":
            self.link += 1
        container, paragraph = tag in CONTAINERS, tag in PARAGRAPHS
        if container or paragraph:
            self.flush()
            if self.open[-1][0] == "p":  # only hidden ones are kept open
                self.pop()
        label, hidden, named, said = judged(tag, attributes)
        _, node, excluded, inside = self.open[-1]
        if container:
            self.tags.append(tag)
            self.labels.append(label)
            self.parents.append(node)
            self.paths.append(mixed(self.paths[node], label))
            if said:
                self.named.append((len(self.tags) - 1, said, inside))
            self.push(tag, len(self.tags) - 1, excluded or hidden or named or (tag == "header" and not inside), inside or tag in ("article", "main"))
        elif excluded or hidden:
            self.push(tag, node, True, inside)
        elif tag == "h1":
            self.head = True

    def push(self, tag: str, node: int, excluded: bool, inside: bool) -> None:
        self.open.append((tag, node, excluded, inside))
        self.many[tag] += 1

    def pop(self) -> str:
        tag = self.open.pop()[0]
        self.many[tag] -= 1
        return tag

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = max(0, self.link - 1)
        if tag in CONTAINERS or tag in PARAGRAPHS:
            self.flush()
        if self.many[tag]:
            while self.pop() != tag:
                pass

    def sums(self) -> list[list[int]]:
        """For each container the characters, those in links, and the main headings in it and below."""
        total = [[0, 0, 0] for _ in self.tags]
        for node, block, linked, head in self.blocks:
            own = total[node]
            own[0] += len(block)
            own[1] += linked
            own[2] += head
        for node in range(len(total) - 1, 0, -1):
            up = total[self.parents[node]]
            for k, v in enumerate(total[node]):
                up[k] += v
        return total

    def tokens(self) -> dict[int, list]:
        """token: parent token, label (null for text), times, characters, of these in links, headings, first place."""
        found: dict[int, list] = {}
        for node, (chars, linked, heads) in enumerate(self.sums()):
            if node:
                entry = found.setdefault(self.paths[node], [self.paths[self.parents[node]], self.labels[node], 0, 0, 0, 0, node])
                for k, v in ((2, 1), (3, chars), (4, linked), (5, heads)):
                    entry[k] += v
        for place, (node, block, linked, head) in enumerate(self.blocks):
            entry = found.setdefault(mixed(self.paths[node], f"={block}"), [self.paths[node], None, 0, 0, 0, 0, place])
            for k, v in ((2, 1), (3, len(block)), (4, linked), (5, int(head))):
                entry[k] += v
        return found

    def take(self, main: int, drops: frozenset[int]) -> list[str]:
        """The blocks in the containers of path ``main``; outside of ``article`` and ``main`` without template text (but for headings), where that is less than half."""
        inside = [False] * len(self.tags)
        for node in range(len(inside)):
            inside[node] = self.paths[node] == main or (node > 0 and inside[self.parents[node]])
        certain = any(path == main and tag in ("article", "main") for path, tag in zip(self.paths, self.tags, strict=True))
        whole = [(block, not (certain or head) and mixed(self.paths[node], f"={block}") in drops) for node, block, _, head in self.blocks if inside[node]]
        fixed = sum(len(b) for b, drop in whole if drop)
        return [b for b, drop in whole if not (drop and 2 * fixed < sum(len(x) for x, _ in whole))] if fixed else [b for b, _ in whole]


def nested(classes: list[list[dict]], parents: dict[int, int]) -> list[dict]:
    """The containers of the classes that lie in one slot: outside of a class, all its tokens have the same container next above."""
    valid = []
    for tokens in classes:
        own = {t["token"] for t in tokens if t["label"] is not None}
        slots = set()
        for token in own:
            up = parents.get(token, 0)
            if up not in own:
                slots.add(up)
        if len(slots) <= 1:
            valid += [t for t in tokens if t["label"] is not None]
    return valid


def deduce(classes: list[list[dict]]) -> tuple[list[int], list[int]]:
    """(main slots, deepest first, and template text) of a host. A class: token, parent, label, pages, times, chars, linked, heads, contents."""
    every = [t for c in classes for t in c]
    tags = {t["token"]: t for t in every if t["label"] is not None}
    parents = {k: t["parent"] for k, t in tags.items()}
    drops = [t for t in every if t["label"] is None and t["contents"] >= LEAST_CONTENTS and t["pages"] >= TEXT_SHARE * tags.get(t["parent"], t)["pages"]]
    data = {k: t["chars"] - t["linked"] for k, t in tags.items()}
    heads = {k: t["heads"] for k, t in tags.items()}
    for t in drops:
        up = t["parent"]
        while up in tags:
            data[up] -= t["chars"] - t["linked"]
            heads[up] -= t["heads"]
            up = parents[up]
    valid = {t["token"]: t for t in nested([[t for t in c if t["times"] == t["pages"]] for c in classes], parents)}
    below: dict[int, list[int]] = {}
    for token in valid:
        up = parents[token]
        while up in tags and up not in valid:
            up = parents[up]
        below.setdefault(up if up in valid else 0, []).append(token)
    preferred = set()
    for token, t in valid.items():
        if t["label"].split(".")[0].split("#")[0] in ("article", "main") and data[token] > 0:
            up = token
            while up in tags:
                preferred.add(up)
                up = parents[up]
    mains: list[tuple[int, float, int]] = []
    left = [(0, 0)]
    while left:
        node, depth = left.pop()
        t = valid.get(node)
        weight = lambda k: data[k] * (PREFERRED if k in preferred else 1) / valid[k]["pages"]
        good = []
        if t is None or t["label"].split(".")[0].split("#")[0] != "article":
            for k in below.get(node, ()):
                bonus = weight(k) - data[k] / valid[k]["pages"]
                whole = weight(k) if t is None else data[node] / t["pages"] + bonus
                if data[k] > 0 and weight(k) >= DOMINANT * whole and (k in preferred or t is None or heads[k] / valid[k]["pages"] >= heads[node] / t["pages"]):
                    good.append(k)
        left += [(k, depth + 1) for k in good]
        if t is not None and data[node] > 0 and sum(valid[k]["pages"] for k in good) < t["pages"]:
            mains.append((depth, weight(node), node))
    return [m for _, _, m in sorted(mains, reverse=True)], [t["token"] for t in drops]


def own_main(page: Page) -> int:
    """The slot of a page that is its own template; 0 is the whole page."""
    found = [{"token": k, "parent": v[0], "label": v[1], "pages": 1, "times": v[2], "chars": v[3], "linked": v[4], "heads": v[5], "contents": 1} for k, v in page.tokens().items()]
    mains, _ = deduce([found])
    return mains[0] if mains else 0


def extract(html: str | None, mains: list[int] | None = None, drops: list[int] | None = None) -> str:
    """The main text by a host's template; without one, or where the page has none of its slots, by the page's own."""
    if not html:
        return ""
    page = Page(html)
    have = set(page.paths)
    main = next((m for m in mains or () if m in have), None)
    return "\n\n".join(page.take(own_main(page) if main is None else main, frozenset(drops or ())))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


TOKENS = "host string, token long, parent long, label string, vector long, times long, chars long, linked long, heads long, content long"


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, url, host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parsed = Page(html or "")
            longest = max((b[1] for b in parsed.blocks), key=len, default="")
            content = 1 << (xxhash.xxh3_64_intdigest(longest.encode("utf-8", "surrogatepass")) % 63)
            for token, (parent, label, times, chars, linked, heads, _) in parsed.tokens().items():
                vector = xxhash.xxh64_intdigest(f"{page} {url} {times}") & 0x7FFFFFFF
                rows.append((host, token, parent, label, vector, times, chars, linked, heads, content))
        columns = list(zip(*rows, strict=True)) or [()] * 10
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])


def templates(pages: DataFrame) -> DataFrame:
    """(host, mains, drops): the main slots and the template text of each host with a template. pages: page_id, url, host, html."""
    tokens = (
        pages.mapInArrow(tokens_of, TOKENS).groupBy("host", "token")
        .agg(
            F.min("parent").alias("parent"), F.max("label").alias("label"), F.sum("vector").alias("vector"), F.count("*").alias("pages"), F.sum("times").alias("times"),
            F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum("heads").alias("heads"), F.bit_count(F.bit_or("content")).cast("long").alias("contents"),
        ).where("pages > 1")
    )
    sizes = pages.groupBy("host").agg(F.count("*").alias("all_pages")).where("all_pages > 1")
    frequent = tokens.join(sizes, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all_pages"))
    token = F.struct("token", "parent", "label", "pages", "times", "chars", "linked", "heads", "contents")
    by_class = frequent.groupBy("host", "vector", "pages").agg(F.collect_list(token).alias("tokens"))
    by_host = by_class.groupBy("host").agg(F.collect_list("tokens").alias("classes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            found = [deduce(classes) for classes in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([m for m, _ in found], longs), pa.array([d for _, d in found], longs)], names=["host", "mains", "drops"])

    return by_host.mapInArrow(run, "host string, mains array<long>, drops array<long>").where("size(mains) > 0")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = cut(templates(given))
    size = found.agg(F.count("*").alias("hosts"), F.sum(F.size("mains") + F.size("drops")).alias("tokens")).first()
    if size["hosts"] <= MAX_BROADCAST_HOSTS and (size["tokens"] or 0) <= MAX_BROADCAST_TOKENS:
        found = F.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(*row) for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(given.dtypes)
    return given.join(found, "host", "left").select("page_id", "url", "html", "mains", "drops").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
