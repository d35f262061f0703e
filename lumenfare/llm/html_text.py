"""Main text of web pages: markup rules, and a host suffix array that finds boilerplate which markup does not name.

Markup decides where it can: text within <article> or <main> is kept, text within menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments (by tag, role, class or id) is dropped. What lies outside articles
forms a page's token stream, and a host's suffix array lists the suffixes of all its streams in order. Suffixes that
agree in their first `RUN` words are neighbours in it, so the array is held cut to that depth, as rows (host, hash of
the next RUN words, page): the groups of a host that hold two pages or more are its repeated substrings of RUN words,
and longer ones are unions of these, so what is covered is the same at any depth. A group is reduced to its smallest and
largest page where it stands, so no host, page or line comes together in one task.

Every page's text is held against the repeated runs. On a page without an article the words that they cover go and all
others stay. In an article one repeated sentence proves nothing, as boxes quote ordinary ones, and pages list the
openings of articles; so a check follows there: blocks go only if a repeat that is cut into blocks alike holds two of
them or more in a row, whole and after the article's first one, and if articles with another first block hold it too,
which makes it a notice or advert of the host. Text that only articles share is no evidence, so pages with a common passage keep it.
"""

from __future__ import annotations

import functools
import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfare.llm.common import Words, bitmap_of, forget, in_bitmap, prepare, share, shared, stored

#: Tokens that two pages of a host must share in a row.
RUN = 8
#: log2 of the bits in the bitmap of repeated runs (1 MB).
BITMAP = 23
#: TEASER: an article by its tag, a card or a reader's comment by its class; one of the others unless the page has no other.
KEEP, DROP, OPEN, TEASER = 0, 1, 2, 3

# Elements whose text is never shown, elements of page furniture, elements that begin a block, and
# elements without an end tag.
HIDDEN = frozenset("script style noscript template svg math head iframe object canvas audio video select textarea".split())
FURNITURE = frozenset("nav header footer aside form button dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of a class, id or role that mark furniture.
MARKS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())

# Words that go with marks in a class, as in `site-footer`, and say nothing by themselves.
NEUTRAL = frozenset("area article articles bar block board bottom box button buttons container content form global inner item left link links list main outer page post posts primary reader right secondary section site slot thread top user widget wrap wrapper".split())
# Words of an article's class that say it leads to another page.
LEADS = frozenset("card preview teaser".split())

_TEXT = re.compile(r"[^<]+")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|</\Z", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# A quote only matters right after `=`; possessive, so that a tag is read once however it ends.
_ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_MARKED = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_UNSEEN = re.compile(r"(?:^|[\s/\"'])hidden(?=[\s/=]|$)(?!\s*=\s*[\"']?until-found)|(?:^|[\s/\"'])style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORDS = re.compile(r"[a-z]+")
_CUT = np.uint64(0x94D049BB133111EB)


@functools.lru_cache(maxsize=4096)
def marked(token: str, within: bool = False) -> bool:
    """Whether a whole class, id or role token marks furniture: its words are marks, and neutral ones beside them. Within
    an article a header is its own."""
    words = [w for w in _WORDS.findall(token) if not (within and w == "header")]
    return any(w in MARKS for w in words) and all(w in MARKS or w in NEUTRAL for w in words)


@functools.lru_cache(maxsize=4096)
def leads(token: str) -> bool:
    """Whether a class token names a card or teaser of something else."""
    words = _WORDS.findall(token)
    return any(w in LEADS for w in words) and all(w in LEADS or w in MARKS or w in NEUTRAL for w in words)


def blocks(page: str) -> list[tuple[int, str]]:
    """(KEEP, DROP or OPEN, text) of the page's blocks in order, white space made single, empty ones left out.

    End tags close the nearest element of their name and all in it; an end tag without one is ignored. `br` is white
    space. Raw elements (script, style) end at their end tag or with the page, and a tag that the page's end cuts is
    dropped. Hidden elements go. An article whose class names a card, teaser or comment goes if it lies within another
    article, or if the page has one without such a class. Every character is read a bounded number of times, whatever is left open.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # element, and its state: KEEP within an article, DROP within furniture
    inside: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []
    state, at, n = OPEN, 0, len(page)

    def close() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((state, text))
            parts.clear()

    while at < n:
        m = _TEXT.match(page, at) or _COMMENT.match(page, at)
        if m:
            if m[0][0] != "<":
                parts.append(m[0])
            at = m.end()
            continue
        m = _NAME.match(page, at)
        if m is None:
            parts.append("<")
            at += 1
            continue
        end, name = _ATTRIBUTES.match(page, m.end()), m[2].lower()
        if end is None:
            break
        attributes, at = end[0][:-1], end.end()
        if m[1]:
            if not inside[name]:
                close() if name in BLOCKS else None
                continue
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
            close() if name in BLOCKS or len(stack) - k > 1 or stack[k][1] != (stack[k - 1][1] if k else OPEN) else None
            inside.subtract(x for x, _ in stack[k:])
            del stack[k:]
            state = stack[-1][1] if stack else OPEN
            continue
        if name in BLOCKS:
            close()
        if name == "br":
            parts.append(" ")
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        new = state
        named = [(k.lower(), w) for k, v in _MARKED.findall(attributes) for w in v.strip("\"'").lower().split()] if attributes else []
        whole = name in ("article", "main") or ("role", "main") in named
        odd = any(marked(w, state in (KEEP, TEASER)) for _, w in named)
        lead = name == "article" and (odd or any(leads(w) for k, w in named if k == "class"))
        if name in HIDDEN or attributes and _UNSEEN.search(attributes) or name in FURNITURE and not (name == "header" and state in (KEEP, TEASER)):
            new = DROP
        elif lead and state == OPEN:
            new = TEASER
        elif lead and state == KEEP or odd and name not in ("html", "body", "article", "main"):
            new = DROP
        elif state != DROP and whole and not (state == TEASER and name == "article"):
            new = KEEP
        if new != state:
            close()
        stack.append((name, new))
        inside[name] += 1
        state = new
    close()
    other = DROP if any(x == KEEP for x, _ in out) else KEEP
    return [(other if x == TEASER else x, t) for x, t in out]


def host_of(url: str | None) -> str:
    """The host in lower case without `www.`; "" where there is none."""
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def page_words(parts: list[tuple[int, str]]) -> list[np.ndarray]:
    """The hashes of each block's words."""
    w = Words([t.encode("utf-8", "surrogatepass") for _, t in parts])
    return [w.hash[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]


def windows(words: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
    """Hashes of RUN words from each place of a stream of word hashes; one of fewer than RUN words has none. begins: which
    words begin a block; a run then counts where it is cut into blocks alike, too."""
    h = np.zeros(max(0, len(words) - RUN + 1), np.uint64)
    for j in range(RUN):
        h = (h ^ words[j : len(h) + j]) * np.uint64(0x9E3779B97F4A7C15)
        if j and begins is not None:
            h[begins[j : len(h) + j]] += _CUT
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cut_windows(words: list[np.ndarray]) -> np.ndarray:
    """The windows() of blocks as they are cut."""
    begins = np.zeros(sum(map(len, words)) + 1, bool)
    begins[np.cumsum([0] + [len(w) for w in words])] = True
    return windows(_joined(words), begins[:-1])


def outside(parts: list[tuple[int, str]]) -> list[int]:
    """Numbers of the blocks outside articles, which are the page's token stream in the suffix array."""
    return [k for k, (state, _) in enumerate(parts) if state != KEEP]


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, np.uint64)


def judged(parts: list[tuple[int, str]]) -> list[int]:
    """Numbers of the blocks that repeats are asked about: those of the article but its first one, or without an article
    the page's token stream."""
    kept = [k for k, (state, _) in enumerate(parts) if state == KEEP]
    return kept[1:] if kept else outside(parts)


def has_article(parts: list[tuple[int, str]]) -> bool:
    return any(state == KEEP for state, _ in parts)


def head_of(parts: list[tuple[int, str]]) -> int | None:
    """A hash of the article's first block, null without an article."""
    first = next((text for state, text in parts if state == KEEP), None)
    return None if first is None else xxhash.xxh64_intdigest(first.encode("utf-8", "surrogatepass")) - (1 << 63)


def edges(words: list[np.ndarray], members: list[int]) -> np.ndarray:
    """Where each of the blocks begins in their stream, and the end."""
    return np.cumsum([0] + [len(words[k]) for k in members])


def whole_blocks(edge: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which blocks lie whole, with the next or the one before, in one stretch of repeated windows that begin at the
    (rising) places."""
    out = np.zeros(len(edge) - 1, bool)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    for i, j in zip(at[first].tolist(), at[np.append(first[1:], len(at)) - 1].tolist() if len(at) else ()):
        a, b = np.searchsorted(edge, i), np.searchsorted(edge, j + RUN, side="right") - 1
        if b - a > 1:
            out[a:b] = True
    return out


def covered(n: int, repeated: np.ndarray) -> np.ndarray:
    """Which of n words lie in the windows that begin at the given places."""
    cover = np.zeros(n + RUN, bool)
    for j in range(RUN):
        cover[repeated + j] = True
    return cover[:n]


def main_text(parts: list[tuple[int, str]], words: list[np.ndarray], repeated: np.ndarray) -> tuple[str, int]:
    """(text, words that repeats took out of it); repeated: the (rising) places of repeated windows in judged().

    With an article its blocks are the text, without the whole_blocks() of the repeats. Without an article the uncovered
    words of the undecided blocks are; a block without such words leaves no line.
    """
    article, members = has_article(parts), judged(parts)
    edge, cover, gone = edges(words, members), {}, 0
    if len(repeated):
        hit = np.repeat(whole_blocks(edge, repeated), np.diff(edge)) if article else covered(int(edge[-1]), repeated)
        cover = {k: hit[a:b] for k, a, b in zip(members, edge[:-1], edge[1:])}
    out = []
    for k, (state, text) in enumerate(parts):
        if state != (KEEP if article else OPEN):
            continue
        hit = cover.get(k)
        if hit is not None and hit.any():
            gone += int(hit.sum())
            text = " ".join(w for w, c in zip(text.split(" "), hit.tolist()) if not c)
        if text:
            out.append(text)
    return "\n".join(out), gone


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, repeated_words) for every row of pages (page_id, url, html).

    repeated_words: how many words repeats took out of the text. A null or empty html has the text ""; a null url has
    the host "". Repeated rows are one page to the suffix array and keep a row each; other columns are ignored; an empty
    table gives an empty result.

    A first scan makes the suffix array's rows and its repeated runs. A second asks a bitmap of these (fixed size)
    about each page's windows: a page whose text no repeat can touch is done there; the few others meet the runs
    themselves, and articles the first blocks of others that hold these. The scan's rows lie in the checkpoint folder in between, so no page is parsed a third time.
    """
    spark = prepare(pages.sparkSession)
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    given = given.withColumn("key", F.xxhash64("page_id", "url", "html"))

    def suffixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in frames:
            rows = []
            for key, url, page in zip(pdf.key, pdf.url, pdf.html):
                words = page_words([p for p in blocks(page) if p[0] != KEEP])
                plain, cut = windows(_joined(words)), cut_windows(words)
                rows.append((key, _host_key(url), np.concatenate([plain, cut[cut != plain]])))
            yield pd.DataFrame(rows, columns=["key", "host", "runs"])

    array = given.select("key", "url", "html").mapInPandas(suffixes, "key long, host long, runs array<bigint>").select("key", "host", F.explode("runs").alias("run"))
    groups = stored(array.groupBy("host", "run").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("host", "run"))
    repeated = share(spark, bitmap_of(groups, F.col("host").bitwiseXOR(F.col("run")), BITMAP))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        (bitmap,) = shared(repeated)
        for pdf in frames:
            rows = []
            for url, page in zip(pdf.url, pdf.html):
                parts, host = blocks(page), _host_key(url)
                words = page_words(parts)
                members, head = judged(parts), head_of(parts)
                stream = [words[k] for k in members]
                every = windows(_joined(stream)) if head is None else cut_windows(stream)
                at = np.flatnonzero(in_bitmap(bitmap, every ^ np.int64(host), BITMAP))
                if head is not None and len(at) and not whole_blocks(edges(words, members), at).any():
                    at = at[:0]
                maybe = [{"at": int(i), "run": int(every[i])} for i in at]
                text = None if maybe else main_text(parts, words, at)[0]
                rows.append((host, head, text, maybe or None, [{"state": x, "text": t} for x, t in parts] if maybe else None))
            out = pd.DataFrame(rows, columns=["host", "head", "text", "maybe", "parts"])
            out["head"] = pd.array([r[1] for r in rows], "Int64")
            out.insert(0, "key", pdf.key.to_numpy())
            out.insert(0, "url", pdf.url.to_numpy())
            out.insert(0, "page_id", pdf.page_id.astype("Int64").array)
            yield out

    seen = stored(given.mapInPandas(judge, "page_id long, url string, key long, host long, head long, text string, maybe array<struct<at:int,run:bigint>>, parts array<struct<state:int,text:string>>"))
    repeated.destroy()
    done = seen.where("maybe is null").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.lit(0).cast("long").alias("repeated_words"))
    rest = seen.where("maybe is not null")
    asked = rest.select("key", "host", "head", F.explode("maybe").alias("m")).select("key", "host", "head", "m.*").join(groups, ["host", "run"], "left_semi")
    several = asked.groupBy("host", "run").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low < high").select("host", "run")
    places = asked.where("head is null").unionByName(asked.where("head is not null").join(several, ["host", "run"], "left_semi")).groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("places"))

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in frames:
            done = []
            for parts, places in zip(pdf.parts, pdf.places):
                parts = [(p["state"], p["text"]) for p in parts]
                done.append(main_text(parts, page_words(parts), np.array(places if places is not None else [], np.int64)))
            yield pd.DataFrame({"page_id": pdf.page_id.astype("Int64"), "url": pdf.url, "text": [t for t, _ in done], "n_chars": [len(t) for t, _ in done], "repeated_words": [n for _, n in done]})

    rows = rest.join(places, "key", "left").select("page_id", "url", "parts", "places")
    return done.unionByName(rows.mapInPandas(texts, "page_id long, url string, text string, n_chars long, repeated_words long"))


def _host_key(url: str | None) -> int:
    return xxhash.xxh64_intdigest(host_of(url)) - (1 << 63)
