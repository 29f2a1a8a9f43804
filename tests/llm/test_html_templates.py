"""op1: template deduction per host, against explicit occurrence vectors."""

import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("llm")

from llm import html_extract as hx  # noqa: E402

SCHEMA = "page_id long, url string, html string, words string, sure int, host string, page string"


def pages(spark, bodies, host="h.example"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", b, "own", 1, "own", "own") for i, b in enumerate(bodies)], SCHEMA)


def texts(spark, bodies, **kw):
    return {r["page_id"]: r["text"] for r in hx.main_text(pages(spark, bodies, **kw)).collect()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.mark.parametrize("count,long", [(20, 300), (20, 20), (7, 300), (3, 40)])
def test_template_is_removed_whatever_its_length(spark, count, long):
    """A long shared block makes no page a copy; small hosts have templates too."""
    rng = random.Random(count + long)
    top, last = words(rng, long), words(rng, 6)
    bodies = [words(rng, 20) for _ in range(count)]
    got = texts(spark, [f"<html><body><div>{top}</div><div>{b}</div><div>{last}</div></body></html>" for b in bodies])
    assert got == dict(enumerate(bodies))


def test_mirrors_keep_their_article(spark):
    rng = random.Random(2)
    article = words(rng, 200)
    got = texts(spark, [f"<html><body><div>{article}</div><div>visit {i}</div></body></html>" for i in range(12)])
    assert all(article in t for t in got.values())


def test_class_words_alone_drop_no_article_text():
    keep = "search-engine market-share job-search notice-board share-price related-work no-sidebar has-comments menuetto"
    page = "<article>" + "".join(f'<p class="{c}">text {c}</p>' for c in keep.split()) + "</article>"
    assert hx.extract(page) == "\n".join(f"text {c}" for c in keep.split())
    drop = "search ad ad-slot sidebar-content share-buttons comment-list site-footer cookie-banner main-menu widget-2 reader-comments related-articles"
    page = "<article><p>text</p>" + "".join(f'<div class="{c}">gone</div>' for c in drop.split()) + "</article>"
    assert hx.extract(page) == "text"


def brute(bodies):
    """Template text tokens of one host from explicit vectors, order and slots."""
    runs = []
    for b in bodies:
        at = defaultdict(list)
        for i, (kind, token, _, _) in enumerate(hx.events(b)):
            if kind in ("tag", "end", "text"):
                at[token].append((i, kind == "text"))
        runs.append(at)
    n = len(bodies)
    vectors = defaultdict(list)
    for t in {t for r in runs for t in r}:
        v = tuple(len(r.get(t, ())) for r in runs)
        if sum(x > 0 for x in v) >= hx.SUPPORT * n:
            vectors[v].append(t)

    def mean(t):
        first = [r[t][0][0] for r in runs if t in r]
        return sum(first) / len(first)

    for v in vectors:
        vectors[v].sort(key=mean)
        if max(v) == 1:
            gone = set()
            for r in runs:
                at = [r[t][0][0] for t in vectors[v] if t in r]
                best = []  # a longest increasing subsequence that ends at each place
                for i, x in enumerate(at):
                    best.append(max((best[k] for k in range(i) if at[k] < x), key=len, default=[]) + [i])
                keep = max(best, key=len, default=[])
                gone |= {t for i, t in enumerate(t for t in vectors[v] if t in r) if i not in keep}
            vectors[v] = [t for t in vectors[v] if t not in gone]
    once = [v for v in vectors if max(v) == 1]
    root = max(once, key=lambda v: len(vectors[v]))

    def good(v):
        kinds = set()
        for r in runs:
            rounds = list(zip(*([i for i, _ in r[t]] for t in vectors[v] if t in r), strict=False))
            if [i for x in rounds for i in x] != sorted(i for x in rounds for i in x):
                return False
            cuts = [i for t in vectors[root] for i, _ in r.get(t, ())]
            if rounds and v != root:
                slots = [{sum(c < i for c in cuts) for i in x} for x in rounds]
                if any(len(s) > 1 for s in slots):
                    return False
                kinds.add(frozenset().union(*slots))
        return len(kinds) <= 1

    return {hx._long(t) for v in vectors if good(v) for t in vectors[v] if any(r[t][0][1] for r in runs if t in r)}


def test_deduction_equals_explicit_vectors(spark):
    rng = random.Random(7)
    notes = [words(rng, 5) for _ in range(7)]
    bodies = []
    for i in range(10):
        rows = "".join(f"<li>{notes[0]}</li><li>{words(rng, 3)}</li>" for _ in range(1 + i % 3))  # as often as there are rows
        twice = f"<p>{notes[2]}</p>"
        swap = [f"<h4>{notes[3]}</h4>", f"<blockquote><h5><i>{notes[4]}</i></h5></blockquote>"][::1 if i % 2 else -1]  # now before, now behind
        rare = f"<h6>{notes[5]}</h6>" if i else ""  # on nine of ten pages
        # once or twice, before or behind the rule
        move = [f"<address><em>{notes[6]}</em></address>" * (1 + i % 3 % 2), ""][::1 if i % 2 else -1]
        bodies.append(f"<html><body><h1>{words(rng, 6)}</h1><div>{notes[1]}</div>{twice}<section>{words(rng, 30)}</section>{move[0]}<hr>{move[1]}"
                      f"{twice}<ul>{rows}</ul>{''.join(swap)}{rare}</body></html>")
    src = pages(spark, bodies).select("page_id", "url", "html")
    got = hx.templates(src.withColumn("host", hx.host_of(src["url"]))).collect()
    assert len(got) == 1 and set(got[0]["words"]) == brute(bodies) and got[0]["sure"]
    out = texts(spark, bodies)
    kept = Counter(n for n in notes for t in out.values() if n in t)
    assert not any(kept[notes[k]] for k in (0, 1, 2, 4, 5))  # nested, once, twice, the longer of two that change places, on most pages
    assert kept[notes[3]] == kept[notes[6]] == 10  # out of order; in no one slot


def test_edges(spark):
    rng = random.Random(9)
    long = words(rng, 60_000)
    bodies = [None, "", "<p>a</p>", "<p>a</p>", f"<article><p>{long}</p></article>"]
    got = texts(spark, bodies)
    assert got == {0: "", 1: "", 2: "a", 3: "a", 4: long}
    twice = pages(spark, ["<p>x</p>"]).union(pages(spark, ["<p>x</p>"]))  # repeated rows of one id
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in hx.main_text(twice).collect()] == [(0, "x", 1)] * 2
    assert hx.main_text(twice.limit(0)).count() == 0
