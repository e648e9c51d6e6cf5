"""Main text of web pages by the suffix array of their host, checked by the markup.

A page is cut into blocks, once. The token streams of all blocks of a host's pages are concatenated, their suffixes sorted, and
every run of ``MIN_RUN`` tokens or more that starts suffixes of ``MIN_PAGES`` distinct pages of the host is cut out; unique
runs stay. Every page of every host goes this way. A page gives two streams, one of its marked articles and one of what
stands outside, whose runs are counted apart: what many articles quote cuts nothing outside of them.

The markup then checks the verdict where it is explicit. Of unique runs, those in elements that are never content (menus, headers,
footers, asides, forms, adverts, notices, comments ...) go; of a header inside an article the headings stay and the rest, such
as a byline, goes. Of repeated runs, those in a marked article are put back, for an article or a sentence that stands on several
pages is no boilerplate. On all other blocks the verdict stands. Scripts, styles and the like give no block.

Suffixes are sorted by doubling to the depth that decides (the first ``MIN_RUN`` tokens), for then suffixes with an
equal start lie side by side. Pages of a host are dealt into groups of ``GROUP_PAGES``, so no task holds a large host, and a run
counts over the host's groups: each group names the places of its runs on a line of more places than the host has words,
packed to a byte or so a run; only runs whose place is taken ``min_pages`` times or more can be repeated, and only these are
then counted exactly. Pages with the same words count as one.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own; broken or cut off markup is
read as far as it goes; rows that repeat, or tie in page_id and url, are extracted each by itself; a very long page, or rows of one
page_id, url and text, are held by one task; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfootprint.llm.frames import plain
from fleetfootprint.session import settle

MIN_RUN = 6
MIN_PAGES = 5
GROUP_PAGES = 200
SLICE_GROUPS = 16
PIECE = 1 << 15
# token codes of articles are turned by this, so that no run of theirs equals one outside of articles
ARTICLE = np.uint64(0xD6E8FEB86659FD93)

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# class names that start with one of these say something about the element around them, not what the element is
MODIFIER = re.compile(r"(?:has|with|without|no|not|is|js|category|tag|type|format|layout|status|page|post|template)[-_]")
# fixed values: element names of the HTML standard by what they mean for the text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
NEVER = frozenset("nav footer aside form dialog menu select button svg canvas object audio video head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead footer comment comments reply replies disqus discussion share sharing social related popup modal overlay toolbar "
    "login search pagination pager widget skip".split()
)


def is_boilerplate(name: str, attributes: str) -> bool:
    """Whether an element's name or attributes say that it is not content."""
    if name in NEVER:
        return True
    if name in ("html", "body", "main") or not attributes:
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            if any(BOILERPLATE.intersection(re.split(r"[^a-z0-9]+", part)) for part in value.split() if not MODIFIER.match(part)):
                return True
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) in page order; kind: article, other, or boilerplate."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    # name, whether it or one above is boilerplate (1: by an article's header alone), whether it or one above is an article
    stack: list[tuple[str, int, bool]] = []
    names: Counter[str] = Counter()
    page = page or ""

    def state() -> tuple[int, bool]:
        return stack[-1][1:] if stack else (0, False)

    def end_block() -> None:
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                bad, article = state()
                out.append(("boilerplate" if bad else "article" if article else "other", words))

    def pop_to(name: str) -> None:
        while stack:
            top = stack.pop()[0]
            names[top] -= 1
            if top == name:
                break

    at = 0
    while True:
        found = TAG.search(page, at)
        piece = page[at : found.start() if found else len(page)]
        if piece:
            text.append(html.unescape(piece))
        if not found:
            break
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            end_block()
        elif name in ("br", "td", "th"):
            text.append(" ")
        if found["close"]:
            if names[name] > 0:
                if name not in BLOCK and state() != _below(stack, name):
                    end_block()
                pop_to(name)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            at = close.end()
            continue
        if name in VOID or found["rest"].endswith("/") and name not in BLOCK and name not in INLINE:
            continue
        if name in BLOCK and names["p"] > 0:
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] in INLINE:
                depth -= 1
            if depth >= 0 and stack[depth][0] == "p":
                pop_to("p")
        if name in ("li", "dd", "dt", "tr", "option") and stack and stack[-1][0] == name:
            pop_to(name)
        bad, article = state()
        worse = 2 if is_boilerplate(name, found["rest"]) or name == "header" and not article else max(bad, int(name == "header"))
        if worse == 1 and name in HEADINGS:
            worse = 0
        if worse != bad and name not in BLOCK:
            end_block()
        stack.append((name, worse, article or name == "article"))
        names[name] += 1
    end_block()
    return out


def _below(stack: list[tuple[str, int, bool]], name: str) -> tuple[int, bool]:
    """State that holds once ``name`` is closed."""
    for depth in range(len(stack) - 1, -1, -1):
        if stack[depth][0] == name:
            return stack[depth - 1][1:] if depth else (0, False)
    return stack[-1][1:] if stack else (0, False)


def sorted_suffixes(streams: list[np.ndarray], page: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the concatenated streams in the order of their first ``min_run`` tokens, where each such start begins among
    them, and which of them are the first of their page at their start. Every stream ends in a token of its own."""
    sizes = np.array([len(s) for s in streams])
    # every stream ends in a token of its own, so no run crosses it
    ends = np.arange(len(streams)) + 1
    codes = np.concatenate([np.r_[s, np.uint64(0)] for s in streams])
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + len(streams) + 1
    rank[np.cumsum(sizes + 1) - 1] = ends
    owner = np.repeat(page, sizes + 1)
    depth = 1
    while depth < min_run:  # ranks of the first ``depth`` tokens become ranks of up to twice as many
        step = min(depth, min_run - depth)
        ahead = np.r_[rank[step:], np.zeros(min(step, len(rank)), np.int64)]
        both = rank * (rank.max() + 1) + ahead
        order = np.argsort(both)
        rank[order] = np.cumsum(np.r_[True, both[order][1:] != both[order][:-1]])
        depth += step
    suffixes = np.argsort(rank * (owner.max() + 1) + owner)
    starts = np.flatnonzero(np.r_[True, rank[suffixes][1:] != rank[suffixes][:-1]])
    new_page = np.r_[True, owner[suffixes][1:] != owner[suffixes][:-1]]
    new_page[starts] = True
    return suffixes, starts, new_page


def repeated(streams: list[np.ndarray], page: np.ndarray, min_run: int, min_pages: int) -> list[np.ndarray]:
    """Per stream of token codes, whether each token lies in a run of ``min_run`` that starts suffixes of ``min_pages`` pages."""
    if not streams:
        return []
    suffixes, starts, new_page = sorted_suffixes(streams, page, min_run)
    pages = np.add.reduceat(new_page.astype(np.int64), starts)
    often = np.zeros(len(suffixes), bool)
    often[suffixes] = np.repeat(pages >= min_pages, np.diff(np.r_[starts, len(suffixes)]))
    ends = np.cumsum([len(s) + 1 for s in streams])
    return [covered(often[end - len(s) - 1 : end - 1], min_run) for s, end in zip(streams, ends)]


def covered(often: np.ndarray, min_run: int) -> np.ndarray:
    """Tokens that lie in a run of ``min_run`` from one of the tokens ``often``."""
    reach = np.cumsum(np.r_[0, often.astype(np.int64)])
    return reach[1:] - reach[np.maximum(np.arange(len(often)) + 1 - min_run, 0)] > 0


def run_codes(stream: np.ndarray, min_run: int) -> np.ndarray:
    """A code for the run of ``min_run`` tokens at each place of a stream that has so many left."""
    codes = np.zeros(max(0, len(stream) - min_run + 1), np.uint64)
    for k in range(min_run):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + stream[k : k + len(codes)]
    return codes


def group_counts(streams: list[np.ndarray], min_run: int, page: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs of streams, each with the number of pages that have it; without ``page`` a stream is a page."""
    if not streams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    suffixes, starts, new_page = sorted_suffixes(streams, np.arange(len(streams)) if page is None else page, min_run)
    pages = np.add.reduceat(new_page.astype(np.int64), starts)
    # laid out as the suffixes are, with a token at the end of each stream
    codes, whole = all_runs(streams, min_run, gap=1)
    first = suffixes[starts]
    whole = whole[first]
    return codes[first][whole], pages[whole]


def all_runs(streams: list[np.ndarray], min_run: int, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs at every place of streams laid end to end, ``gap`` places after each, and whether the run ends in its stream."""
    sizes = np.array([len(s) + gap for s in streams])
    flat = np.concatenate([x for s in streams for x in (s, np.zeros(gap, np.uint64))] if gap else streams)
    codes = np.zeros(len(flat), np.uint64)
    found = run_codes(flat, min_run)
    codes[: len(found)] = found
    left = np.repeat(np.cumsum(sizes) - gap, sizes) - np.arange(len(flat))
    return codes, left >= min_run


def cut(covered: np.ndarray, min_run: int) -> np.ndarray:
    """What of a block goes: all of it where all is covered, else its covered runs that are long enough by themselves."""
    if covered.all() or not covered.any():
        return covered
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False]))
    out = np.zeros(len(covered), bool)
    for begin, end in zip(edges[::2], edges[1::2]):
        out[begin:end] = end - begin >= min_run
    return out


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values whose bits all depend on all bits of the given ones."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def token_codes(text: bytes) -> np.ndarray:
    """Codes of the tokens of a text with one space between any two: sums of their bytes, each times a number of its place."""
    out, at = [], 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = end if end >= 0 else len(text)
        piece = np.frombuffer(text, np.uint8, end - at, at)
        spaces = np.flatnonzero(piece == 32)
        starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(piece)]
        place = np.arange(len(piece)) - np.repeat(starts, np.diff(np.r_[starts, len(piece)]))
        weights = mixed(np.arange(1, int((ends - starts).max()) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        values = (piece.astype(np.uint64) + np.uint64(1)) * weights[place]
        values[spaces] = 0
        out.append(mixed(np.add.reduceat(values, starts)))
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def streams_of(pages: list[tuple[str, list[str]]]) -> list[np.ndarray]:
    """Token codes of what stands outside of each page's marked articles, and of its articles, in turn."""
    texts = [" ".join([words for kind, words in zip(kinds, lines) if (kind == "a") == marked]) for kinds, lines in pages for marked in (False, True)]
    codes = token_codes(" ".join([text for text in texts if text]).encode())
    found = np.split(codes, np.cumsum([text.count(" ") + 1 if text else 0 for text in texts])[:-1])
    return [stream ^ ARTICLE if i % 2 else stream for i, stream in enumerate(found)]


def packed_blocks(kinds: str, lines: list[str]) -> bytes:
    """A page's kinds and lines, none of which has a line break, for the shuffle."""
    return zlib.compress("\n".join([kinds, *lines]).encode(), 1)


def unpacked_blocks(page: bytes) -> tuple[str, list[str]]:
    kinds, *lines = zlib.decompress(page).decode().split("\n")
    return kinds, lines


def is_in(codes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``codes`` are among the ``ordered`` ones."""
    if not len(ordered):
        return np.zeros(len(codes), bool)
    return ordered[np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)] == codes


def unique_runs(kinds: str, lines: list[str], gone: tuple[np.ndarray, np.ndarray], min_run: int = MIN_RUN) -> tuple[str, int, int]:
    """Text of a page's blocks (a: article, o: open, b: boilerplate), its words that the array cuts, and how many of these are put
    back; ``gone`` has the tokens in repeated runs outside of articles and in them."""
    some = gone[0].any(), gone[1].any()
    out, at, n_repeated, n_restored = [], [0, 0], 0, 0
    for kind, words in zip(kinds, lines):
        which, n_cut = int(kind == "a"), 0
        if some[which]:
            begin, at[which] = at[which], at[which] + words.count(" ") + 1
            cut_ = cut(gone[which][begin : at[which]], min_run)
            n_cut = int(np.count_nonzero(cut_))
            n_repeated += n_cut
        # the check by markup: never content, whatever is unique; an article, whatever is repeated
        if kind == "b":
            continue
        if kind == "a":
            n_restored += n_cut
        elif n_cut:
            words = " ".join([w for w, c in zip(words.split(" "), cut_) if not c])
        if words:
            out.append(words)
    return "\n".join(out), n_repeated, n_restored


def packed(places: np.ndarray) -> bytes:
    """Ordered places as their steps, first all lowest bytes, then all second ones ...: the high ones are zeros that compress away."""
    return np.diff(places, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(steps: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(8, -1).T).view("<u8")[:, 0])


def places_of(codes: np.ndarray, bits: int) -> np.ndarray:
    """Places of runs on a line of 2^``bits``."""
    return codes >> np.uint64(64 - bits)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, the page's blocks (``packed_blocks``; kinds a, o or b), a code of all their words, and whether a
    block is open, that is, the markup does not say what it is."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for frame in frames:
            found = [blocks(page) for page in frame["html"]]
            kinds = ["".join([kind[0] for kind, _ in f]) for f in found]
            lines = [[words for _, words in f] for f in found]
            codes = np.array([xxhash.xxh64_intdigest(" ".join(x)) for x in lines], np.uint64).view(np.int64)
            packed_ = [packed_blocks(*page) for page in zip(kinds, lines)]
            yield plain(frame.drop(columns="html")).assign(words=codes, open=["o" in k for k in kinds], blocks=packed_)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    rows = rows.withColumn("host", host_of(F.col("url")))
    return rows.mapInPandas(parse, "page_id long, url string, host string, words long, open boolean, blocks binary")


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, group_pages: int = GROUP_PAGES, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url and text of ``pages`` (page_id, url, html), the page's words that its host's array cuts (``n_repeated``), and
    how many of these the markup puts back (``n_restored``)."""

    def groups_of(frame: pd.DataFrame) -> Iterator[tuple[str, int, pd.DataFrame]]:
        for (host, part), group in frame.groupby(["host", "part"], sort=False):
            yield host, part, group

    def streams_in(group: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
        """Both streams of each different page of a group, those too short for a run left out, and the codes of their pages."""
        different = group.drop_duplicates("words")
        found = streams_of([unpacked_blocks(page) for page in different["blocks"]])
        long = np.array([len(stream) >= MIN_RUN for stream in found], bool)
        return [stream for stream, take in zip(found, long) if take], np.repeat(different["words"].to_numpy(), 2)[long]

    def frame_of(rows: list[tuple], **kinds: str) -> pd.DataFrame:
        values = zip(*rows) if rows else [()] * len(kinds)
        return pd.DataFrame({name: pd.Series(list(v), dtype=kind) for (name, kind), v in zip(kinds.items(), values)})

    def propose(frame: pd.DataFrame) -> pd.DataFrame:
        """Places of the runs of each group by its suffix array, as often as they count."""
        out = []
        for host, part, group in groups_of(frame):
            streams_, page = streams_in(group)
            codes, n = group_counts(streams_, MIN_RUN, np.unique(page, return_inverse=True)[1])
            parts, bits = int(group["parts"].iat[0]), int(group["bits"].iat[0])
            if parts == 1:  # the group is the host
                codes, n = codes[n >= min_pages], n[n >= min_pages]
            places = np.sort(np.repeat(places_of(codes, bits), np.minimum(n, min_pages)))
            slices = -(-parts // SLICE_GROUPS)
            slice_ = (places * np.uint64(slices) >> np.uint64(bits)).astype(np.int64)
            edges = np.searchsorted(slice_, np.arange(slices + 1))
            out += [(host, part, i, packed(places[a:b])) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
        return frame_of(out, host=object, part="int32", slice="int32", places=object)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        """Places that are taken often enough by all groups of a host, for each group that has them."""
        out = []
        for (host, _), group in frame.groupby(["host", "slice"], sort=False):
            found = [unpacked(places) for places in group["places"]]
            taken, n = np.unique(np.concatenate(found), return_counts=True)
            taken = taken[n >= min_pages]
            for part, places in zip(group["part"], found):
                places = np.unique(places[is_in(places, taken)])
                if len(places):
                    out.append((host, part, packed(places)))
        return frame_of(out, host=object, part="int32", places=object)

    def count(frame: pd.DataFrame, often: pd.DataFrame) -> pd.DataFrame:
        """Each group's runs at these places, with ``min_pages`` at most of the different pages that have them."""
        out = []
        at = {k: np.unique(np.concatenate([unpacked(p) for p in g["places"]])) for k, g in often.groupby(["host", "part"], sort=False)}
        for host, part, group in groups_of(frame):
            if (host, part) not in at:
                continue
            streams_, page = streams_in(group)
            names = np.repeat(page, [len(s) for s in streams_])
            runs, whole = all_runs(streams_, MIN_RUN)
            has = np.flatnonzero(whole)
            has = has[is_in(places_of(runs[has], int(group["bits"].iat[0])), at[host, part])]
            has = has[np.lexsort((names[has], runs[has]))]
            runs, names = runs[has], names[has]
            fresh = np.r_[True, (runs[1:] != runs[:-1]) | (names[1:] != names[:-1])][: len(runs)]
            runs, names = runs[fresh], names[fresh]
            edges = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1], True]) if len(runs) else [0]
            out += [(host, part, runs[a].astype(np.int64), names[a : min(b, a + min_pages)]) for a, b in zip(edges[:-1], edges[1:])]
        return frame_of(out, host=object, part="int32", run="int64", pages=object)

    def decide(frame: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
        out = []
        runs = {k: np.sort(g["run"].to_numpy().view(np.uint64)) for k, g in common.groupby(["host", "part"], sort=False)}
        for host, part, group in groups_of(frame):
            found = [unpacked_blocks(page) for page in group["blocks"]]
            streams_ = streams_of(found)
            codes, whole = all_runs(streams_, MIN_RUN)
            gone = covered(whole & is_in(codes, runs.get((host, part), np.zeros(0, np.uint64))), MIN_RUN)
            gone = np.split(gone, np.cumsum([len(s) for s in streams_])[:-1])
            for i, u, page, outside, article in zip(group["page_id"].astype(object), group["url"], found, gone[::2], gone[1::2]):
                out.append((None if pd.isna(i) else int(i), None if pd.isna(u) else u, *unique_runs(*page, (outside, article))))
        return frame_of(out, page_id="Int64", url=object, text=object, n_repeated="int64", n_restored="int64")

    # hosts with the groups their pages are dealt into; a line has three places or so for two words of a host
    sizes = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.octet_length("html").alias("size")).groupBy("host")
    sizes = sizes.agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.ceil(F.count(F.lit(1)) / group_pages).cast("int").alias("parts"),
        F.least(F.lit(40), F.ceil(F.log2(F.coalesce(F.sum("size"), F.lit(0)) / 4 + 1024))).cast("int").alias("bits"),
    )
    hosts = settle(sizes, "hosts")
    # small hosts share a group
    groups = -(-(hosts.agg(F.sum("n_pages")).first()[0] or 1) // group_pages)

    def key(*columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(groups)).alias("key")

    part = F.pmod(F.xxhash64("page_id", "url", "words", F.lit(13)), F.col("parts")).cast("int").alias("part")
    dealt = parsed_pages(pages).join(hosts, "host").select("page_id", "url", "host", part, "parts", "bits", "words", "blocks")
    # one shuffle of the blocks, read three times: by propose, count and decide
    streams = dealt.select(key("host", "part"), *dealt.columns).groupBy("key")
    places = streams.applyInPandas(propose, "host string, part int, slice int, places binary")
    often = places.groupBy(key("host", "slice")).applyInPandas(merge, "host string, part int, places binary")
    counted = streams.cogroup(often.groupBy(key("host", "part"))).applyInPandas(count, "host string, part int, run long, pages array<long>")
    total = counted.groupBy("host", "run").agg(F.flatten(F.collect_list("pages")).alias("pages"), F.collect_list("part").alias("parts"))
    common = total.filter(F.size(F.array_distinct("pages")) >= min_pages).select("host", F.explode("parts").alias("part"), "run")
    return streams.cogroup(common.groupBy(key("host", "part"))).applyInPandas(
        decide, "page_id long, url string, text string, n_repeated long, n_restored long"
    )
