"""The whole extraction of pages against brute force over known blocks, and pages with several kinds of containers."""

import html
import os
import random

import pytest

from fleetfootprint.llm import pages

SF = "/root/testdata/sf0.01"


def extract(spark, rows, **options):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.extract(frame, **options).collect()}


def test_a_card_beside_the_main_text(spark):
    page = '<body><nav>Menu</nav><main><h1>Story</h1><p>The long story of the day.</p></main><article class="card">Teaser of another story</article></body>'
    other = "<main><p>Only a main text.</p></main>"
    assert extract(spark, [(1, "http://a/1", page), (2, "http://a/2", other)]) == {
        1: "Story\nThe long story of the day.\nTeaser of another story", 2: "Only a main text."
    }


def test_headers_of_articles_keep_headings(spark):
    page = (
        "<header><h1>Site</h1></header><article><header><p>News</p><hgroup><h1>Title</h1><p>Subtitle</p></hgroup><p>By A. Person</p>"
        '<time>today</time></header><p>Body</p><header><h2 class="ad">Buy</h2><nav><h2>Menu</h2></nav></header></article>'
    )
    assert extract(spark, [(1, None, page)]) == {1: "Title\nSubtitle\nBody"}


def test_very_long_pages(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    paragraphs = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    page = "".join(f"<div>{p}</div>" for p in paragraphs)
    got = extract(spark, [(1, "http://a/1", page), (2, "http://b/1", f"<article>{' '.join(words)}</article>"), (3, "http://b/2", "<p>" * 20_000 + "x")])
    assert got == {1: "\n".join(paragraphs), 2: " ".join(words), 3: "x"}


def brute(sites):
    """Texts of pages given as (host, blocks): runs by tuples, pages by their whole outside, cuts by definition."""
    outside = [tuple(w for kind, text in blocks for w in text.split() if kind != "a") for _, blocks in sites]
    where = {}
    for (host, _), stream in zip(sites, outside):
        for i in range(len(stream) - pages.MIN_RUN + 1):
            where.setdefault((host, stream[i : i + pages.MIN_RUN]), set()).add(stream)
    texts = []
    for (host, blocks), stream in zip(sites, outside):
        gone = [False] * len(stream)
        for i in range(len(stream) - pages.MIN_RUN + 1):
            if len(where[host, stream[i : i + pages.MIN_RUN]]) >= pages.MIN_PAGES:
                gone[i : i + pages.MIN_RUN] = [True] * pages.MIN_RUN
        at, out = 0, []
        for kind, text in blocks:
            words = text.split()
            if kind == "a":
                out.append(text)
                continue
            mask = gone[at : at + len(words)]
            at += len(words)
            if kind != "o":
                continue
            left, i = [], 0
            while i < len(words):
                j = i
                while j < len(words) and mask[j] == mask[i]:
                    j += 1
                # a covered stretch goes if it is a run by itself, or all of the block
                if not mask[i] or not (j - i >= pages.MIN_RUN or j - i == len(words)):
                    left += words[i:j]
                i = j
            if left:
                out.append(" ".join(left))
        texts.append("\n".join(out))
    return texts


@pytest.mark.parametrize("group_pages", [200, 7])
def test_extraction_by_brute_force(spark, group_pages):
    rng = random.Random(group_pages)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 14))) for _ in range(8)]
    tags = {"a": [("<article><p>", "</p></article>")], "o": [("<div>", "</div>"), ("<section><p>", "</p></section>")], "b": [("<nav>", "</nav>"), ('<div class="ad">', "</div>")]}
    sites = []
    for i in range(90):
        blocks = []
        for _ in range(rng.randint(1, 7)):
            kind = rng.choice("aoob")
            text = rng.choice(shared) if rng.random() < 0.6 else " ".join(f"u{rng.randrange(50)} &" for _ in range(rng.randint(1, 9)))
            if rng.random() < 0.2:
                text = f"x{i} {text} y{i}"
            blocks.append((kind, text))
        sites.append((rng.choice(["one", "two", "two", "two"]), blocks))
    sites += [("one", sites[0][1])] * 3
    rows = []
    for i, (host, blocks) in enumerate(sites):
        body = "".join(f"{a}{html.escape(text)}{b}" for kind, text in blocks for a, b in [rng.choice(tags[kind])])
        rows.append((i, f"https://{host}/{i}", f"<html><body>{body}</body></html>"))
    got = extract(spark, rows, group_pages=group_pages)
    want = brute(sites)
    plain = ["\n".join(t for k, t in blocks if k != "b") for _, blocks in sites]
    assert [got[i] for i in range(len(sites))] == want and sum(a != b for a, b in zip(want, plain)) > 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_given_pages_have_nothing_to_decide(spark):
    """The share of pages that the suffix array decides on the driver's tables: none, as all they have is marked."""
    parsed = pages.parsed_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    assert parsed.filter("open").count() == 0
