"""Main text of web pages by equivalence-class template deduction.

Tokens are tags and text runs, told apart by their path (element names,
classes and ids).  A token's occurrence vector is its count on each page of
its host; tokens of one vector form an equivalence class.  Vectors are never
built: their fingerprint is the sum of hash(page, count), so classes come
from one map-side combined aggregation.  A class is valid if it is on enough
of the host's pages and its tokens come in the same order, as often as they
are repeated, on each of them; a class of tokens that occur once a page is
split first: tokens outside a longest run in order, on any page, leave it.
The largest such class is the root; its tokens cut a page into slots.  Any
other valid class is nested if each of its rounds lies within one slot, and if
these are the same slots on every page (a second pass reports breaches).
The text of the root and of the nested classes is the host's template text;
what else stands in the slots is data.  Extraction takes the data, without
blocks whose path says menu, header, footer, sidebar, notice, advert, form,
script, style or comment, of the article or main element or, without one, of
the page.

Copies of one article count once in a host's statistics: else a host of
mirrors would take its article for template.  They are told by what is left
of the pages without the runs that most of the host shares, so a long template
makes no page a copy; runs of a few words (dates, counters) don't tell pages
apart.

Only tokens on at least SUPPORT of a host's pages are kept, so a host's
template is no larger than a few pages; templates join the pages by host as
a stored table, which Spark broadcasts when it is small.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import releasing, small_batches, stored

#: Share of a host's pages that a class is on, the least number of different
#: pages to deduce from, and the number from which template text is removed
#: from an article or main element, too.
SUPPORT, MIN_PAGES, SURE_PAGES = 0.9, 3, 8
#: Pages agree in their longest runs up to this share of the text; runs of fewer words than RUN_WORDS don't count.
COPY, RUN_WORDS = 0.8, 4

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)
 |<(?P<raw>script|style|textarea|title|xmp|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
 |<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:"[^"]*"|'[^']*'|[^'">])*+)>
 |<(?P<end2>/)?(?P<name2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*)(?:>|\Z)
 |<[!?/][^>]*(?:>|\Z)
 |(?P<text>[^<]+|<)""", re.S | re.I | re.X)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary "
                  "table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html head option optgroup td th tr tbody thead tfoot dd dt li".split()) | frozenset(["li", "dd", "dt"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("ul ol dl table select div section article main body html td th blockquote".split())
#: Elements, roles and words of class or id that hold no article text.
OUT_TAGS = frozenset("nav footer aside form head noscript template iframe svg math select button dialog menu object canvas audio video datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars aside rail menu menus nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist disqus replies reply respond "
    "related recommended recommendations share sharing social widget widgets search login skip".split())
#: Words that say where or how, not what: a class of such words and of OUT_WORDS holds no article text.
NEUTRAL_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons card col column container content count counter desktop entry field fixed "
    "floating form global group icon icons inner input item items label left link links list main media mobile outer page panel post posts primary "
    "reader readers right row secondary section sections site slot slots sticky stories sub text thread title tools top unit user users web wrap "
    "wrapper zone".split())
NEGATED = frozenset("has with no without not".split())


def _out(name: str, attrs: str, in_main: bool) -> bool:
    if name in OUT_TAGS or (name == "header" and not in_main):
        return True
    if name in ("html", "body") or not attrs:
        return False
    for key, value in _ATTR.findall(attrs):
        for cls in value.strip("\"'").lower().split():
            if key.lower() == "role":
                if cls in OUT_ROLES:
                    return True
                continue
            words = [w for w in re.split(r"[^a-z0-9]+", cls) if w]
            if not words or words[0] in NEGATED:
                continue
            named = [w for w in words if w in OUT_WORDS]
            if named and all(w in OUT_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words):
                return True
            if not in_main and words in (["header"], ["site", "header"], ["page", "header"]):
                return True
    return False


class Node:
    __slots__ = ("name", "path", "out", "main")

    def __init__(self, name, path, out, main):
        self.name, self.path, self.out, self.main = name, path, out, main


def _label(name: str, attrs: str) -> str:
    if not attrs:
        return name
    return name + "".join(sorted(f" {k.lower()}={v.strip(chr(34) + chr(39))}" for k, v in _ATTR.findall(attrs) if k.lower() != "role"))


def events(page: str) -> Iterator[tuple[str, int, Node, str]]:
    """(kind, token, node, text): kinds ``tag``, ``end``, ``text`` and ``break``; ``node`` holds the path."""
    stack = [Node("", 0, False, False)]
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            top = stack[-1]
            if text.strip():
                clean = " ".join(entities.unescape(text).split())
                yield "text", xxhash.xxh64_intdigest(clean.encode("utf-8", "surrogatepass"), top.path ^ 1), top, text
            else:
                yield "space", 0, top, text
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, attrs = name.lower(), m["attr"] or m["attr2"] or ""
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    node = stack[i]
                    del stack[i:]
                    yield "end", xxhash.xxh64_intdigest(b"/", node.path), node, name
                    break
            else:
                if name in BLOCK:
                    yield "space", 0, stack[-1], " "
            continue
        if name in CLOSES_P:
            _close(stack, {"p"}, frozenset(("button", "td", "th", "table", "body", "article", "div", "section", "main")))
        if name in SIBLINGS and name != "p":
            _close(stack, SIBLINGS[name], SCOPE - {"td", "th"} if name == "tr" else SCOPE - SIBLINGS[name])
        top = stack[-1]
        path = xxhash.xxh64_intdigest(_label(name, attrs).encode("utf-8", "surrogatepass"), top.path)
        node = Node(name, path, top.out or _out(name, attrs, top.main), top.main or name in ("article", "main"))
        yield "tag", path, node, name
        if name not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)


def _close(stack: list[Node], names: set, scope: frozenset) -> None:
    """Close the innermost open element of ``names`` that is within the scope."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            return
        if stack[i].name in scope:
            return


def blocks(page: str, words: frozenset = frozenset()):
    """Text blocks in page order: (text, out, main, all template text).

    ``words`` are tokens of template text."""
    parts, meta, fixed = [], None, True

    def flush():
        nonlocal parts, fixed, meta
        text = " ".join(entities.unescape("".join(parts)).split())
        got = (text, meta[0], meta[1], fixed) if text else None
        parts, fixed, meta = [], True, None
        return got

    last_out = None
    for kind, token, node, text in events(page):
        if kind in ("tag", "end"):
            if text in BLOCK or (kind == "tag" and node.out != last_out):
                if parts and (got := flush()):
                    yield got
            elif text == "br":
                parts.append(" ")
            continue
        if kind == "text":
            if parts and meta is not None and node.out != meta[0] and (got := flush()):
                yield got
            last_out = node.out
            if meta is None:
                meta = (node.out, node.main)
            fixed &= token in words
        parts.append(text)
    if parts and (got := flush()):
        yield got


def extract(page: str | None, words=(), sure: bool = True) -> str:
    """The article's blocks, one a line.  ``words``: the host's template text
    (unless ``sure``, an article or main element keeps it)."""
    if not page:
        return ""
    found = [b for b in blocks(page, frozenset(words)) if not b[1]]
    main = [b for b in found if b[2]]
    kept = [b for b in main or found if not b[3]] if sure or not main else main
    # an article or main element that is mostly template text is a copied article
    if main and 2 * sum(len(b[0]) for b in kept) < sum(len(b[0]) for b in main):
        kept = main
    return "\n".join(b[0] for b in kept or found)


# -- template deduction -----------------------------------------------------

def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _occurrences(page: str | None) -> dict[int, list]:
    """token -> [count, first position, is text]"""
    seen: dict[int, list] = {}
    for i, (kind, token, _, _) in enumerate(events(page or "")):
        if kind in ("tag", "end", "text"):
            x = seen.get(token)
            if x is None:
                seen[token] = [1, i, kind == "text"]
            else:
                x[0] += 1
    return seen


def _ordered(tokens: list[int], seen: dict[int, list[int]]) -> bool:
    """Whether the tokens of a class on a page come in order, round by round."""
    at = [seen[t] for t in tokens if t in seen]
    flat = [i for around in zip(*at, strict=False) for i in around]
    return flat == sorted(flat)


def _wanderers(tokens: list[int], seen: dict[int, list[int]]) -> list[int]:
    """The tokens, each once on the page, outside a longest subsequence that is in order."""
    have = [t for t in tokens if t in seen]
    tops: list[int] = []  # least last position of a run of each length
    ends: list[int] = []  # its token's index
    before = [-1] * len(have)
    for i, t in enumerate(have):
        k = bisect_left(tops, seen[t][0])
        if k:
            before[i] = ends[k - 1]
        tops[k:k + 1], ends[k:k + 1] = [seen[t][0]], [i]
    keep, i = set(), ends[-1] if ends else -1
    while i >= 0:
        keep.add(i)
        i = before[i]
    return [t for i, t in enumerate(have) if i not in keep]


def _positions(page: str | None, tokens) -> dict[int, list[int]]:
    """Where each of the tokens occurs on the page."""
    seen: dict[int, list[int]] = {t: [] for t in tokens}
    for i, (_, token, _, _) in enumerate(events(page or "")):
        if (at := seen.get(_long(token))) is not None:
            at.append(i)
    return {t: at for t, at in seen.items() if at}


def _nested(tokens: list[int], seen: dict[int, list[int]], cuts: list[int]) -> frozenset | None:
    """The slots (between ``cuts``) of a class on a page; None if a round is in more than one."""
    at = [seen[t] for t in tokens if t in seen]
    slots = set()
    for around in zip(*at, strict=False):
        of = {bisect_left(cuts, i) for i in around}
        if len(of) > 1:
            return None
        slots |= of
    return frozenset(slots)


def _copies(pages: DataFrame) -> DataFrame:
    """(host, page) of all pages but one of each set of copies.  Rows that
    are equal in all columns count as one page here."""
    text = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1\s*>|\z)", "<>")
    runs = pages.select("host", "page", F.split(text, "<[^>]*>").alias("r")).withColumn(
        "r", F.expr(f"transform(filter(r, x -> size(split(trim(x), '\\\\s+')) >= {RUN_WORDS}), x -> struct(-length(trim(x)) as n, xxhash64(trim(x)) as h))"))
    runs = stored(runs.dropDuplicates(["host", "page"]), "page-runs")
    many = runs.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    shared = (runs.select("host", F.explode(F.array_distinct("r.h")).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("on"))
              .join(many, "host").where(F.col("on") >= F.greatest(F.lit(2), SUPPORT * F.col("pages"))).groupBy("host").agg(F.collect_set("h").alias("shared")))
    # no more than the runs of a page or two per host
    left = runs.join(stored(shared, "shared-runs"), "host", "left").withColumn(
        "r", F.expr("array_sort(filter(r, x -> shared is null or not array_contains(shared, x.h)))"))
    total = left.withColumn("total", F.expr("aggregate(r, 0L, (a, x) -> a - x.n)"))
    sign = F.expr(f"aggregate(r, struct(0L as seen, 0L as h), (a, x) -> if(a.seen < {COPY} * total, struct(a.seen - x.n as seen, xxhash64(a.h, x.h) as h), a)).h")
    signed = stored(total.select("host", "page", sign.alias("sign")), "page-signs")
    first = signed.groupBy("host", "sign").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(signed.join(first, ["host", "sign"]).where("page != first").select("host", "page").distinct(), "copies")


@releasing
def templates(pages: DataFrame) -> DataFrame:
    """(host, words: the text tokens of its template, sure: whether it rests on
    SURE_PAGES), for hosts of at least MIN_PAGES different pages.  ``pages``
    has host, page_id, url, html."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(h, p, _long(t), c, i, w) for h, p, page in zip(df["host"], df["page"], df["html"], strict=True)
                    for t, (c, i, w) in _occurrences(page).items()]
            yield pd.DataFrame(rows, columns=["host", "page", "token", "n", "at", "word"])

    src = pages.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")
    src = src.join(_copies(src), ["host", "page"], "left_anti").select("host", "page", "html")
    hosts = src.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= MIN_PAGES)
    tokens = (src.mapInPandas(count, "host string, page long, token long, n long, at long, word boolean")
              .groupBy("host", "token")
              .agg(F.count(F.lit(1)).alias("on"), F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"),
                   F.max("n").alias("most"), F.avg("at").alias("at"), F.max("word").alias("word")))
    classes = stored(tokens.join(hosts, "host").where(F.col("on") >= SUPPORT * F.col("pages"))
                     .groupBy("host", "pages", F.col("vector").cast("string").alias("vector"))
                     .agg(F.max("most").alias("most"), F.array_sort(F.collect_list(F.struct("at", "token", "word"))).alias("c")), "classes")
    # only hosts with text in some class matter
    classes = stored(classes.join(classes.where("exists(c, x -> x.word)").select("host").distinct(), "host", "left_semi"), "classes")
    pages_of = src.select("host", "html")
    packed = lambda c, *more: stored(c.groupBy("host").agg(F.collect_list(F.struct("vector", F.col("c.token").alias("tokens"), *more)).alias("classes")), "host-classes")

    def wander(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = set()
            for host, page, some in zip(df["host"], df["html"], df["classes"], strict=True):
                seen = _positions(page, (t for c in some for t in c["tokens"]))
                out.update((host, t) for c in some for t in _wanderers(c["tokens"], seen))
            yield pd.DataFrame(list(out), columns=["host", "token"])

    loose = (pages_of.join(packed(classes.where("most = 1 and size(c) > 1")), "host").mapInPandas(wander, "host string, token long")
             .groupBy("host").agg(F.collect_set("token").alias("loose")))
    classes = classes.join(stored(loose, "loose"), "host", "left").withColumn(
        "c", F.expr("filter(c, x -> loose is null or not array_contains(loose, x.token))")).where("size(c) > 0").drop("loose")
    classes = stored(classes, "classes")
    root = classes.where("most = 1").groupBy("host").agg(F.max(F.struct(F.size("c"), "vector"))["vector"].alias("root"))
    # only classes with text matter, and the root
    classes = stored(classes.join(root, "host", "left").where("vector <=> root or exists(c, x -> x.word)"), "classes")

    def breaches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = set()
            for host, page, some in zip(df["host"], df["html"], df["classes"], strict=True):
                seen = _positions(page, (t for c in some for t in c["tokens"]))
                cuts = sorted(i for c in some if c["vector"] == c["root"] for t in c["tokens"] for i in seen.get(t, ()))
                for c in some:
                    if c["vector"] == c["root"] or not any(t in seen for t in c["tokens"]):
                        continue
                    slots = _nested(c["tokens"], seen, cuts)
                    broken = slots is None or not _ordered(c["tokens"], seen)
                    if broken or cuts:
                        rows.add((host, c["vector"], None if broken else repr(sorted(slots))))
            yield pd.DataFrame(list(rows), columns=["host", "vector", "slots"])

    found = stored(pages_of.join(packed(classes, "root"), "host").mapInPandas(breaches, "host string, vector string, slots string").distinct(), "nests")
    bad = found.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("slots").isNull()).alias("broken")).where("kinds > 1 or broken > 0")
    valid = classes.join(bad, ["host", "vector"], "left_anti")
    words = F.expr("flatten(collect_list(transform(filter(c, x -> x.word), x -> x.token)))")
    return valid.groupBy("host").agg(words.alias("words"), (F.max("pages") >= SURE_PAGES).alias("sure"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text,
    n_chars.

    Null or empty html gives empty text.  Pages with a null or relative url
    share the host ''.  Repeated rows are extracted each (copies count once in
    their host's statistics); an empty table gives no rows; other columns are
    not read."""
    small_batches(pages.sparkSession)
    src = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    found = templates(src)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            text = [extract(p, () if w is None else [t % (1 << 64) for t in w.tolist()], bool(sure))
                    for p, w, sure in zip(df["html"], df["words"], df["sure"], strict=True)]
            yield pd.DataFrame({"page_id": df["page_id"], "url": df["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = src.join(found, "host", "left").select("page_id", "url", "html", "words", F.coalesce("sure", F.lit(False)).alias("sure"))
    kind = src.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
