"""Runs that pages of a host share are counted over the whole host, however its pages are grouped."""

import collections

import numpy as np
import pytest

from fleetfootprint.llm import pages

MENU = "Section menu with Home News About and Contact"
SHARED = "this very sentence of an article stands on two pages"


def page(host, i, n_menu):
    menu = f"<div>{MENU}</div>" if i < n_menu else ""
    shared = f"<p>{SHARED}</p>" if i in (0, 1) else ""
    return f"{menu}<p>{' '.join(f'{host}w{i}x{k}' for k in range(12))}</p>{shared}"


@pytest.mark.parametrize("group_pages", [200, 10])
def test_a_host_decides_as_a_whole(spark, group_pages):
    # pages with the menu, all pages: few of many, less than the minimum, and a small host
    hosts = {"many": (7, 120), "rare": (pages.MIN_PAGES - 1, 120), "small": (8, 8)}
    rows = [(n * 1000 + i, f"http://{h}/{i}", page(h, i, m)) for n, (h, (m, size)) in enumerate(hosts.items()) for i in range(size)]
    # the same stream again and again is one page, wherever its copies are dealt
    rows += [(9000 + i, f"http://copies/{i}", f"<p>{MENU} once more</p>") for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(frame, group_pages=group_pages).collect()}
    assert len(got) == len(rows)
    for n, (h, (m, size)) in enumerate(hosts.items()):
        for i in range(size):
            text = got[n * 1000 + i]
            assert (MENU in text) == (i < m and m < pages.MIN_PAGES), (h, i)
            assert (SHARED in text) == (i in (0, 1)), (h, i)
            assert f"{h}w{i}x0 " in text
    assert all(got[9000 + i] == f"{MENU} once more" for i in range(60))


def test_counts_of_a_group_by_brute_force():
    rng = np.random.default_rng(3)
    streams = [rng.integers(1, 4, rng.integers(0, 40)).astype(np.uint64) for _ in range(9)]
    want = collections.Counter(c for s in streams for c in set(pages.run_codes(s, 4).tolist()))
    codes, n = pages.group_counts(streams, 4)
    assert dict(zip(codes.tolist(), n.tolist())) == dict(want)
