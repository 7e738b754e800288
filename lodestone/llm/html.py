"""Main text of web pages by consensus of each host's container paths.

1. Each page is read once into blocks of text; a block knows its chain of containers. Every container is scored by
   the text of its own paragraphs less the text of their links, half of it handed on to the container above
   (so that an article split in sections still wins), with bonuses and penalties by tag, class, id and role.
2. The page's best container votes with its generalised path (tags and classes, digits as #) for its host. Votes are
   added up in Spark, in part before the shuffle, so a host with a third of all pages costs no task more.
3. Pages are read again and give the text of the containers at the host's winning paths, in order of votes; a page
   that has none of them falls back on its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments inside the container
are left out; headings of the article stay. Signs are weighed against the text. An element that is noise only as a form or
by a part of a class or id ("has-sidebar") is a wrapper if it holds most of the text that no other sign speaks against, and
stays as a section of an article if it has paragraphs of its own. An element that is noise by a whole class or id
("widget") or its role holds the article if hardly any text stands outside such elements; one that is named for readers'
comments, consent or adverts only if none does. The winners of hosts travel to the workers if they take up no
more than ``BROADCAST`` bytes; beyond, pages are joined to them by host.

Cases: null html is empty and gives an empty text; a page without tags is one block; unclosed tags, comments
and scripts end with the page; rows with a null or odd url vote under the empty host; repeated rows, rows without an id and
rows that share an id each get their row; very long pages are read whole; containers with equal scores are told apart by
their place, paths with equal votes by score and name; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Share of a host's votes with which a path is kept, the largest table of winners that is sent to every worker, characters of a path that is written out.
SHARE, BROADCAST, LONGEST = 0.01, 32 << 20, 1_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<raw>script|style|noscript|template|svg|math|textarea|iframe|select|title|object|xmp)\b(?:"[^"]*"|'[^']*'|[^'">])*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:"[^"]*"|'[^']*'|[^'">]|["'](?=[^"'<>]*>))*+)>
    |</[^a-zA-Z][^>]*>""",
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")

# Element names of HTML by role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input embed param source track area link meta base col".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside form header head menu button dialog fieldset frameset legend option".split())
READERS = frozenset("comment comments disqus replies reply respond ad ads advert adverts advertisement advertising consent cookie cookies gdpr login newsletter signup subscribe".split())  # and other things that are long beside a short article
WRAPPERS = frozenset("form fieldset".split())  # noise unless they hold most of the page
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
CLOSES = {  # an opening tag ends these open elements
    "p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"},
}
#: A block's own element is no container if it only holds a paragraph.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption summary address center".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


class Node:
    __slots__ = ("tag", "path", "up", "noise", "soft", "named", "score", "bonus", "at", "inside", "paragraphs")

    def __init__(self, tag, path, up, noise, soft, named, bonus, at):
        self.tag, self.path, self.up, self.noise, self.soft, self.named, self.bonus, self.at = tag, path, up, noise, soft, named, bonus, at
        self.paragraphs = 0
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))  # an article
        self.score = 0.0


def _made(tag: str, attrs: str, up: Node, at: int) -> Node:
    inside = up.inside or up.tag in ("article", "main")
    noise, soft = tag in NOISE_TAGS and tag not in WRAPPERS and not (inside and tag == "header"), tag in WRAPPERS
    bonus, classes, named = 25.0 if tag in ("article", "main") else 0.0, "", 0  # named: 1 by a name or role, 2 for readers
    if attrs and "=" in attrs or "hidden" in attrs:
        a = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
        names = a.get("class", "").lower().split()
        words = {w for k in (*names, a.get("id", "").lower()) for w in re.split(r"[^a-z]+", k) if w}
        if tag not in ("html", "body", "article", "main"):
            whole = {*names, a.get("id", "").lower()} & NOISE_WORDS
            named = 2 if whole & READERS else int(bool(whole))
            parts = (words - {"header"} if inside else words) & NOISE_WORDS
            soft |= bool(parts) and not (inside and tag in LEAVES)  # a paragraph of the article, "share-price", is told by a whole name only
        named = named or int(a.get("role", "").lower() in NOISE_ROLES)
        noise |= "hidden" in attrs.split() or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
        bonus += 10.0 * bool(words & GOOD_WORDS) + 25.0 * (a.get("role") in ("main", "article"))
        if names:
            classes = "." + ".".join(sorted({re.sub(r"\d+", "#", k) for k in names}))
    return Node(tag, _step(up.path, f">{tag}{classes}"), up, noise, soft, named, bonus, at)


def _step(path: str, step: str) -> str:
    """The path one step further; a long one is told by a digest of all of it and its end, so that different containers keep different paths."""
    out = path + step
    if len(out) <= LONGEST:
        return out
    return f"#{hashlib.blake2b(out.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}{step[-200:]}"


def read(page: str):
    """The page's blocks, (container, text, characters in links), in page order; the containers."""
    root = Node("", "", None, False, False, 0, 0.0, 0)
    nodes, stack, blocks = [root], [root], []
    text: list[str] = []
    link = links = 0

    def flush():
        nonlocal links
        if text:
            t = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if t:
                blocks.append((stack[-1], t, links))
            links = 0

    def put(s):
        nonlocal links
        text.append(s)
        if link:
            links += len(s)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m[0].startswith("<![CDATA["):
                continue
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link = 0 if m["end"] else 1
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        link = 0
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        ends = CLOSES.get(tag) or ({"p"} if tag in ENDS_P else ())
        while len(stack) > 1 and stack[-1].tag in ends:
            stack.pop()
        if tag in VOID:
            continue
        node = _made(tag, m["attr"], stack[-1], len(nodes))
        nodes.append(node)
        stack.append(node)
    if at < len(page):
        rest = page[at:]
        k = rest.rfind("<")
        if k >= 0 and re.match(r"</?[a-zA-Z!][^>]*\Z", rest[k:]):  # a tag that the page's end cuts off
            rest = rest[:k]
        put(rest)
    flush()
    _quiet(blocks, nodes)
    return blocks, nodes


#: Text outside of named elements beside which one of them is no article: a share of its own, and characters for those of readers; characters and paragraphs of a section; rounds.
OUTSIDE, READ, SECTION, ROUNDS = 0.1, 40, (150, 2), 8


def _quiet(blocks, nodes):
    """Settle which containers are noise: their own by their signs, weighed, and all that stands in such."""
    signed = [n for n in nodes if not n.noise and (n.soft or n.named)]
    if signed:
        gains = [(node, max(len(t) - 2 * links, 0)) for node, t, links in blocks]
        for n in nodes:
            n.noise |= n.up is not None and n.up.noise
        if any(n.named for n in signed):
            _release(gains)
        for n in nodes:  # those above come first
            n.noise |= bool(n.named) or n.up is not None and n.up.noise
        total = 0
        for node, gain in gains:
            if node.noise:
                continue
            total += gain
            paragraph = node.tag in LEAVES and gain > 0
            while node is not None:
                node.score += gain
                node.paragraphs += paragraph
                node = node.up
        for n in signed:
            section = n.inside and n.tag not in WRAPPERS and n.score >= SECTION[0] and n.paragraphs >= SECTION[1]
            n.noise |= n.soft and n.score * 2 <= total and not section
    for n in nodes:
        n.noise |= n.up is not None and n.up.noise


def _release(gains):
    """Take the sign from named elements that hold the article: hardly any text stands outside such elements."""
    for _ in range(ROUNDS):  # one may stand in another
        outside, held = 0, defaultdict(int)
        for node, gain in gains:
            if node.noise:
                continue
            top = None
            while node is not None:
                top = node if node.named else top
                node = node.up
            if top is None:
                outside += gain
            else:
                held[top] += gain
        found = [n for n, gain in held.items() if outside <= gain * OUTSIDE and (n.named < 2 or outside <= READ) and gain == max(held.values())]
        if not found:
            return
        min(found, key=lambda n: (n.named, n.at)).named = 0


def best(blocks, nodes) -> Node:
    """The container with the highest score; the root where no block qualifies."""
    for node in nodes:
        node.score = node.bonus
    worth = 0.0
    for node, t, links in blocks:
        if node.noise:
            continue
        gain = max(len(t) - 2.0 * links, 0.0) + (1.0 if not links else 0.0)
        while node.tag in LEAVES and node.up is not None:
            node = node.up
        share = 1.0
        while node is not None and share > 0.05:
            node.score += gain * share
            share /= 2
            node = node.up
        worth += gain
    top = max((n for n in nodes if not n.noise and n.tag not in LEAVES), key=lambda n: (n.score, -n.at), default=nodes[0])
    return top if worth else nodes[0]


def inside(node, path: str) -> bool:
    while node is not None:
        if node.path == path:
            return True
        node = node.up
    return False


def main_text(page: str, paths: list[str]) -> str:
    """The text at the first of the host's ``paths`` that the page has, else at the page's own best container."""
    blocks, nodes = read(page)
    have = {n.path for n in nodes if not n.noise}
    for path in paths:
        if path in have:
            out = [t for n, t, _ in blocks if not n.noise and inside(n, path)]
            if out:
                return "\n".join(out)
    top = best(blocks, nodes)

    def under(n):
        while n is not None:
            if n is top:
                return True
            n = n.up
        return False

    return "\n".join(t for n, t, _ in blocks if not n.noise and under(n))


def _votes(batches):
    for batch in batches:
        votes: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0, 0.0])
        for host, page in zip(batch.column("host"), batch.column("html"), strict=True):
            if not (page := page.as_py()):
                continue
            blocks, nodes = read(page)
            top = best(blocks, nodes)
            if top.up is not None and blocks:
                v = votes[host.as_py(), top.path]
                v[0] += 1
                v[1] += min(top.score, 1e6)
        yield pa.record_batch([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array([v[0] for v in votes.values()], pa.int64()), pa.array([v[1] for v in votes.values()], pa.float64())], ["host", "path", "votes", "score"])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """host, paths: the container paths with at least ``share`` of the host's votes, most votes first; 1 / share of them at most.

    Votes are counted by host and path, and the share is taken before any path is gathered, so that a host with very
    many paths makes no large array.
    """
    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(_votes, "host string, path string, votes long, score double")
    total = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    least = total.groupBy("host").agg((F.sum("votes") * share).alias("least"))
    total = total.join(least, "host").where("votes >= least")
    ranked = total.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("votes", F.round("score", 3).alias("score"), "path")), False).alias("best"))
    return ranked.select("host", F.col("best.path").alias("paths"))


def _extracted(shared):
    def run(batches):
        for batch in batches:
            texts = []
            paths = batch.column("paths") if shared is None else None
            for i, (host, page) in enumerate(zip(batch.column("host"), batch.column("html"), strict=True)):
                own = (paths[i].as_py() or []) if shared is None else shared.value.get(host.as_py(), [])
                texts.append(main_text(page.as_py() or "", own))
            yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return run


def _with_paths(rows: DataFrame, winners: DataFrame, salts: int = 64) -> DataFrame:
    """The rows with their host's paths; each host is dealt over ``salts`` tasks, since one may hold a third of all pages."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("id", F.length("html")), F.lit(salts)).cast("int"))
    wide = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(wide, ["host", "_salt"], "left").drop("_salt")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """One row for each page: id, url, text, n_chars."""
    from .common import cut

    winners = cut(host_paths(pages, url_col, html_col))
    size = winners.agg(F.sum(F.length("host") + F.length(F.concat_ws("", "paths")) + 200)).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    kind = rows.schema["id"].dataType.simpleString()
    if size <= broadcast:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.paths for r in winners.toLocalIterator()})
    else:
        shared, rows = None, _with_paths(rows, winners)
    return rows.mapInArrow(_extracted(shared), f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
