"""Main text of web pages through a suffix array over each host's pages."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import column_of, durable, records, slices, tidied
from lectern.llm.heavy import stored
from lectern.llm.markup import ATTRIBUTE, MARKUP, RAW, RAW_END
from lectern.llm.repetition import suffix_ranks, union_sizes
from lectern.llm.url_filter import host_of

# Elements and words of class, id and role attributes by what they hold.
SILENT = frozenset("template svg math object canvas audio video".split())
CHROME = frozenset("nav footer aside form menu dialog button select label legend datalist".split())
PHRASES = frozenset("button label legend".split())
FIELDS = frozenset("input select textarea button".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
SPACES = frozenset("br td th img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
KEPT = frozenset("div section span ul ol table li p article main".split())
#: What the start of an element ends, if it is still open; any block ends a paragraph.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar widget widgets menu navbar nav navigation breadcrumb breadcrumbs footer masthead comment comments feedback disqus reply replies respond related recommended recommendations pagination pager toolbar skip adsbygoogle".split()
)
HEADER_WORDS = frozenset("header topbar site page main top global bar wrapper wrap container inner".split())
GENERIC_WORDS = frozenset(
    "area article articles bar block box button buttons container content entry form global google header inner item items left link links list main middle news page panel post posts primary reader right rail secondary section site slot stories thread top bottom topics unit user users widget wrap wrapper zone".split()
)

ASKED = ("class", "id", "role", "itemprop", "hidden", "aria-hidden", "style")
WORDS = re.compile(r"[a-z0-9]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
PHRASE_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in PHRASES}
TAG = {name: re.compile(f"<(/?){name}(?=[\\s/>])[^>]*", re.I) for name in SILENT | PHRASES}
#: What a place of text is; MARKED is what the page itself marks as its article.
PLAIN, DROPPED, MARKED, MAIN, ARTICLE, FORM = range(6)
#: Signs of text beside its fields from which a form is no form but a page, and so many a field; signs that a page lost in menus has at least.
FORM_TEXT, FIELD_TEXT, LOST_TEXT = 400, 100, 250
PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("blocks", pa.list_(pa.string())), ("kinds", pa.list_(pa.int8()))])
WHOLE = PARSED.append(pa.field("content", pa.int64())).append(pa.field("bare", pa.bool_())).append(pa.field("n", pa.int64()))
RUNS = pa.schema([("bucket", pa.int64()), ("runs", pa.list_(pa.int64())), ("contents", pa.list_(pa.int64())), ("bare", pa.list_(pa.bool_()))])
SHARED = pa.schema([("content", pa.int64()), ("runs", pa.list_(pa.int64()))])
KEYS = pa.schema([("host", pa.string()), ("pages", pa.int64()), ("runs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
BOUND = pa.schema([("host", pa.string()), ("least", pa.int64()), ("keys", pa.list_(pa.int32()))])
HITS = pa.schema([("host", pa.string()), ("pages", pa.int64()), ("runs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def is_chrome(word: str) -> bool:
    """Whether a word of a label, or both halves of it, names a menu, a notice, comments or the like."""
    halves = ((word[:k], word[k:]) for k in range(2, len(word) - 1))
    known = CHROME_WORDS | GENERIC_WORDS
    return word in CHROME_WORDS or word not in known and any(a in known and b in known and (a in CHROME_WORDS or b in CHROME_WORDS) for a, b in halves)


def _opens(name: str, rest: str, inside: bool) -> int:
    """What an element makes of its content: DROPPED, FORM, MAIN, ARTICLE or as around it (PLAIN)."""
    if name in CHROME or name == "header" and not inside:
        return FORM if name == "form" else DROPPED
    found = {}
    if len(rest) > 2 and any(a in rest.lower() for a in ASKED):
        for m in ATTRIBUTE.finditer(rest):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if found:
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "").lower()):
            return DROPPED
        role = found.get("role", "").strip().lower()
        if role in ROLES:
            return FORM if role == "form" else DROPPED
        if name not in ("html", "body", "main"):
            for label in unescape(found.get("class", "") + " " + found.get("id", "")).split():
                # "post-comments", "userComments", "commentlist" or "ad-slot-2", but neither "has-sidebar" nor "ad-free"
                words = {w for x in WORDS.findall(HUMP.sub("-", label).lower()) if (w := x.rstrip("0123456789"))}
                chrome = {w for w in words if is_chrome(w)}
                if chrome and words <= chrome | GENERIC_WORDS or not inside and words & {"header", "topbar"} and words <= HEADER_WORDS:
                    return DROPPED
        if role == "article" or found.get("itemprop", "").lower() == "articlebody":
            return ARTICLE
        if role == "main":
            return MAIN
    return ARTICLE if name == "article" else MAIN if name == "main" else PLAIN


class Place:
    """A part of a page: what it is, in which other part, whether it was closed, its fields, and whether it calls itself an article though it is dropped."""

    __slots__ = ("kind", "parent", "closed", "fields", "named")

    def __init__(self, kind: int, parent: int, named: bool = False):
        self.kind, self.parent, self.closed, self.fields, self.named = kind, parent, False, 0, named


def balanced_end(name: str, text: str, at: int) -> int | None:
    """Where the element that has been opened before ``at`` ends, after its end tag; None if it is never closed."""
    depth = 1
    for m in TAG[name].finditer(text, at):
        if not m[0].endswith("/"):
            depth += -1 if m[1] else 1
        if not depth:
            return min(len(text), m.end() + 1)
    return None


def parse(html: str | None) -> tuple[list[str], list[int]]:
    """The blocks of text of a page in order, and of each what its place is: PLAIN, DROPPED or MARKED.

    MARKED is what the page itself marks as its article (``judged``). Raw text (scripts,
    styles, titles) ends at its own end tag, whatever it holds; a head may lack one, as
    nothing in a head but its title is text. Drawings and players without an end are as if
    they were not there, and a button or label without one ends at the next tag.
    """
    blocks: list[str] = []
    at_place: list[int] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, place around it, place of its own or -1
    places = [Place(PLAIN, -1)]
    now = 0
    text = html or ""
    at = 0
    endless: set[str] = set()

    def close():
        if parts:
            block = " ".join("".join(parts).split())
            parts.clear()
            if block:
                blocks.append(block)
                at_place.append(now)

    def within(kinds) -> bool:
        p = now
        while p >= 0:
            if places[p].kind in kinds:
                return True
            p = places[p].parent
        return False

    while True:
        m = MARKUP.search(text, at)
        start = m.start() if m else len(text)
        if start > at:
            raw = text[at:start]
            parts.append(unescape(raw) if "&" in raw else raw)
        if not m:
            break
        name = m["name"]
        at = m.end()
        if name is None:
            continue
        name, rest = name.lower(), m["rest"]
        if name in BREAKS:
            close()
        elif name in SPACES:
            parts.append(" ")
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close()
                    now = stack[k][1]
                    if stack[k][2] >= 0:
                        places[stack[k][2]].closed = True
                    del stack[k:]
                    break
                # an end tag does not reach over a table's cell, nor one of running text over a block
                if name not in TABLE and stack[k][0] in ("table", "td", "th") or name not in BREAKS and stack[k][0] in BREAKS:
                    break
            continue
        if name in FIELDS and not (name == "input" and "hidden" in rest.lower()):
            places[now].fields += 1
        if name in RAW:
            end = RAW_END[name].search(text, at)
            at = end.start() if end else len(text)
        elif name in SILENT:
            if not rest.endswith("/") and name not in endless:
                end = balanced_end(name, text, at)
                at = end if end is not None else at
                if end is None:
                    endless.add(name)
        elif name in PHRASES:
            end, again = PHRASE_END[name].search(text, at), TAG[name].search(text, at)
            whole = end is not None and (again is None or again.start() >= end.start())
            following = text.find("<", at)
            at = end.start() if whole else following if following >= 0 else len(text)
        elif name not in VOID and not rest.endswith("/"):
            ends = ENDS.get(name, {"p"} if name in BREAKS else ())
            while stack and stack[-1][0] in ends:
                close()
                now = stack.pop()[1]
            here = places[now].kind
            inside = within((MAIN, ARTICLE))
            opened = _opens(name, rest, inside)
            own = None
            if opened == ARTICLE and (here == DROPPED or not within((ARTICLE,)) or name == "article"):
                own = Place(ARTICLE, now)
            elif opened == MAIN and (here == DROPPED or not inside):
                own = Place(MAIN, now)
            elif opened in (DROPPED, FORM) and here != DROPPED:
                own = Place(opened, now, name == "article")
            if own is not None or name in KEPT:
                if own is not None:
                    close()
                stack.append((name, now, len(places) if own is not None else -1))
                if own is not None:
                    now = len(places)
                    places.append(own)
    close()
    marked, dropped = judged(blocks, at_place, places)
    return blocks, [MARKED if p in marked else DROPPED if p in dropped else PLAIN for p in at_place]


def judged(blocks: list[str], at_place: list[int], places: list[Place]) -> tuple[set[int], set[int]]:
    """Which places hold the page's article, and which are dropped.

    The largest article counts, with those at least half as large; smaller ones are teasers.
    An article inside another is a comment or the like unless it is more than twice as large
    as what is around it. What the main part holds beside its articles decides if it is more
    than they are.

    A form that holds a marked part, or much text beside its fields, is no form but what is
    around it. A page must
    not be lost: where nothing is marked and little is left, articles in dropped places
    count, then dropped places that were never closed.
    """
    own = [0] * len(places)
    for b, p in zip(blocks, at_place, strict=True):
        own[p] += len(b)
    whole = list(own)  # with what lies inside, without what is dropped there
    for k in range(len(places) - 1, 0, -1):
        if places[k].kind != DROPPED:
            whole[places[k].parent] += whole[k]
    marks = [own[k] > 0 and p.kind in (MAIN, ARTICLE) for k, p in enumerate(places)]  # marked, or a form that holds what is
    for k in range(len(places) - 1, 0, -1):
        if marks[k] and places[places[k].parent].kind == FORM:
            marks[places[k].parent] = True
    open_ = [True] * len(places)  # not in a dropped place
    for k in range(1, len(places)):
        p = places[k]
        kept = p.kind != DROPPED and not (p.kind == FORM and not marks[k] and whole[k] < max(FORM_TEXT, FIELD_TEXT * p.fields))
        open_[k] = kept and open_[p.parent]

    def around(k: int) -> int:
        """The nearest place around that is no form."""
        k = places[k].parent
        while places[k].kind == FORM:
            k = places[k].parent
        return k

    held = [0] * len(places)  # of each article and of the main part, with the forms in it that are none
    for k, size in enumerate(own):
        if open_[k] or places[k].kind in (MAIN, ARTICLE):
            held[around(k) if places[k].kind == FORM else k] += size
    spread = lambda chosen: {k for k in range(len(places)) if k in chosen or places[k].kind == FORM and open_[k] and around(k) in chosen}
    fit = [k for k, p in enumerate(places) if p.kind == ARTICLE and open_[k] and held[k] and (places[around(k)].kind != ARTICLE or held[k] > 2 * held[around(k)])]
    most = max((held[k] for k in fit), default=0)
    fit = [k for k in fit if 2 * held[k] >= most]
    main = [k for k, p in enumerate(places) if p.kind == MAIN and open_[k]]
    if sum(held[k] for k in main) > sum(held[k] for k in fit):
        fit = main
    dropped = {k for k in range(len(places)) if not open_[k]}
    left = sum(own[k] for k in range(len(places)) if open_[k])
    if not sum(held[k] for k in fit):
        lost = [k for k, p in enumerate(places) if not open_[k] and (p.kind in (MAIN, ARTICLE) or p.named)]
        most = max((own[k] for k in lost), default=0)
        if most >= max(LOST_TEXT, 4 * left):
            return {k for k in lost if 2 * own[k] >= most}, dropped
        unclosed = [k for k in dropped if places[k].kind == DROPPED and not places[k].closed and open_[places[k].parent]]
        most = max((own[k] for k in unclosed), default=0)
        if most >= max(LOST_TEXT, 4 * left):
            dropped -= {k for k in unclosed if 2 * own[k] >= most}
    return spread(set(fit)), dropped


def repeated_tokens(streams: list[np.ndarray], least_run: int, least_pages=(2,)) -> list[list[np.ndarray]]:
    """For each page's tokens, which lie in a run of ``least_run`` (a power of two) tokens that so many pages have.

    The streams are concatenated and their suffixes ranked by doubling up to that length;
    suffixes of one rank are the ends of common prefixes long enough, and their pages are
    counted. Pages with equal streams count as one. One list of flags a number of
    ``least_pages``.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    n = int(sizes.sum())
    if n == 0:
        return [[np.zeros(0, bool) for _ in streams] for _ in least_pages]
    tokens = np.concatenate(streams)
    ends = np.repeat(np.cumsum(sizes), sizes)
    same: dict[bytes, int] = {}
    page = np.repeat(np.array([same.setdefault(s.tobytes(), len(same)) for s in streams], np.int64), sizes)
    rank = suffix_ranks(tokens, ends, np.zeros(n, np.int64), least_run)[-1]
    full = np.flatnonzero(np.arange(n) + least_run <= ends)
    order = full[np.lexsort((page[full], rank[full]))]
    r, p = rank[order], page[order]
    head = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, bool)
    other = head.copy()
    other[1:] |= p[1:] != p[:-1]
    group = np.cumsum(head) - 1
    pages = np.bincount(group, weights=other)[group] if len(group) else group
    out = []
    for least in least_pages:
        starts = order[pages >= least]
        out.append(np.split(union_sizes(starts, np.full(len(starts), least_run), n), np.cumsum(sizes)[:-1]))
    return out


def common_pages(pages: int) -> int:
    """On how many different pages of a host that has so many a run is the site's and no page's own: nine of ten, five at least.

    Less would take the title lines that near copies of one article share on a host.
    """
    return max(5, -(-9 * pages // 10))


def main_texts(pages: list[tuple[list[str], list[int]]], least_run: int = 8) -> list[str]:
    """The main text of each of some pages of one host."""
    ids: dict[str, int] = {}
    streams = [np.array([ids.setdefault(w, len(ids)) for b in blocks for w in b.split(" ")], np.int64) for blocks, _ in pages]
    most = common_pages(len({s.tobytes() for s in streams if len(s)}))
    repeated, common = repeated_tokens(streams, least_run, (2, most))
    return [main_text(blocks, kinds, c if MARKED in kinds else r) for (blocks, kinds), r, c in zip(pages, repeated, common, strict=True)]


def main_text(blocks: list[str], kinds: list[int], covered: np.ndarray) -> str:
    """The main text of a page, of whose tokens ``covered`` tells which lie in repeated runs.

    A block goes if half of it or more is covered. On a page that does not mark its article,
    two pages make a repeat, and what stands in menus, forms, notices and the like goes
    though it be unique. On one that does, nothing outside the mark stays, and inside it
    only runs common to the host count, as copies and passages of an article repeat too;
    where these hold half of the article, it is itself what is common, and stays whole.
    """
    cut = np.cumsum([0] + [b.count(" ") + 1 for b in blocks])
    total = np.concatenate([[0], np.cumsum(covered)])
    held, size = total[cut[1:]] - total[cut[:-1]], np.diff(cut)
    unique = 2 * held < size
    if MARKED in kinds:
        inside = np.array(kinds) == MARKED
        if 2 * held[inside].sum() >= size[inside].sum():
            unique[:] = True
        return "\n".join(b for b, k, u in zip(blocks, inside.tolist(), unique.tolist(), strict=True) if k and u)
    return "\n".join(b for b, k, u in zip(blocks, kinds, unique.tolist(), strict=True) if u and k != DROPPED)


def run_hashes(blocks: list[str], host: str | None, least_run: int) -> np.ndarray:
    """A 64-bit hash (as int64) of the ``least_run`` (a power of two) tokens from each place of a host's page."""
    seed = xxhash.xxh64_intdigest((host or "").encode("utf-8", "surrogatepass"))
    h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for b in blocks for w in b.split(" ")], np.uint64)
    size = 1
    while size < least_run:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (h[size:] ^ h[size:] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        size *= 2
    return h.view(np.int64)


def shared_runs(pages: DataFrame, least_run: int, bucket_runs: int = 1_000_000) -> DataFrame:
    """(content, runs): for each bare page the hashes of its runs that another content of its host has too.

    ``pages`` has host, blocks, content, bare and n (tokens). Each content once; its runs
    are dealt by their hash, host and all, so no task gets a host whole, and every run is
    compared with all of the host's pages.
    """
    one = pages.groupBy("content").agg(F.first("host").alias("host"), F.first("blocks").alias("blocks"), F.max("bare").alias("bare"), F.first("n").alias("n"))
    one = durable(one)
    buckets = 1 + (one.agg(F.sum("n")).first()[0] or 0) // bucket_runs

    @tidied
    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [np.unique(run_hashes(b, h, least_run)) for b, h in zip(column_of(part, "blocks").to_pylist(), column_of(part, "host").to_pylist(), strict=True)]
                owner = np.repeat(np.arange(len(made)), [len(m) for m in made])
                runs = np.concatenate(made)
                bucket = (runs.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                runs, owner, bucket = runs[order], owner[order], bucket[order]
                contents, bare = column_of(part, "content").to_numpy()[owner], column_of(part, "bare").to_numpy(zero_copy_only=False)[owner]
                names, starts = np.unique(bucket, return_index=True)
                cut = lambda x: np.split(x, starts[1:]) if len(starts) else []
                yield records([names, cut(runs), cut(contents), cut(bare)], RUNS)

    def tally(group: pa.Table) -> pa.Table:
        runs, contents, bare = (pa.concat_arrays(group.column(c).chunks).flatten().to_numpy(zero_copy_only=False) for c in ("runs", "contents", "bare"))
        _, where, n = np.unique(runs, return_inverse=True, return_counts=True)
        mine = (n[where] > 1) & bare
        runs, contents = runs[mine], contents[mine]
        order = np.argsort(contents, kind="stable")
        names, starts = np.unique(contents[order], return_index=True)
        return pa.Table.from_batches([records([names, np.split(runs[order], starts[1:]) if len(starts) else []], SHARED)])

    dealt = one.mapInArrow(deal, "bucket bigint, runs array<bigint>, contents array<bigint>, bare array<boolean>")
    return dealt.groupBy("bucket").applyInArrow(tally, "content bigint, runs array<bigint>").groupBy("content").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def first_pages(pages: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``pages`` without those whose host and content an earlier row has.

    Only host, content and ``place`` (a number of its own for each row) are shuffled: the
    places of first rows come back as bits, 64 a number, which are broadcast if short.
    """
    firsts = pages.groupBy("host", "content").agg(F.min("place").alias("place"))
    word = F.shiftright("place", 6).alias("word")
    bits = durable(firsts.groupBy(word).agg(F.expr("bit_or(shiftleft(1L, int(place & 63)))").alias("bits")))
    bits = F.broadcast(bits) if bits.count() <= most_broadcast else bits
    return pages.select("*", word).join(bits, "word").where("getbit(bits, int(place & 63)) = 1").select(*pages.columns)


def keys_of(runs: np.ndarray) -> np.ndarray:
    """The lower half of each hash, for half the room."""
    return runs.view(np.uint64).astype(np.uint32).view(np.int32)


def common_runs(pages: DataFrame, least_run: int, part_runs: int = 4_000_000, most_broadcast: int = 5_000_000) -> DataFrame:
    """(host, common): for each large host the hashes of the runs that nine of ten of its different pages have.

    ``pages`` has host, blocks, content and place. Each content counts once. Every page is
    counted twice, where it lies. At first a task counts the keys of all runs, in parts of
    about ``part_runs``, and tells of each part and host the keys that more than half of its
    pages have. A key not told is on half of a part's pages at most, which bounds on how many
    pages of the host any key is; no run on nine of ten has a lower bound than that. Then the
    runs of the keys that reach it are counted over all pages, and what is on nine of ten goes.
    """
    pages = first_pages(pages.where(F.size("blocks") > 0))

    def tally(batches, pick, told, schema):
        held, size = {}, 0

        def part():
            made = [np.unique(np.concatenate(h), return_counts=True) for h in held.values()]
            made = [(r[told(c, len(h))], c[told(c, len(h))]) for (r, c), h in zip(made, held.values(), strict=True)]
            return records([list(held), [len(h) for h in held.values()], [r for r, _ in made], [c for _, c in made]], schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for host, runs in pick(batch.slice(at, 256)):
                    held.setdefault(host, []).append(runs)
                    size += len(runs) + 1
                    if size >= part_runs:
                        yield part()
                        held, size = {}, 0
        if held:
            yield part()

    @tidied
    def keys(batches):
        def pick(rows):
            for host, blocks in zip(column_of(rows, "host").to_pylist(), column_of(rows, "blocks").to_pylist(), strict=True):
                yield host, np.unique(keys_of(run_hashes(blocks, host, least_run)))

        yield from tally(batches, pick, lambda counts, n: 2 * counts > n, KEYS)

    def bound(group: pa.Table) -> pa.Table:
        n, told = group.column("pages").to_numpy(), group.column("runs").combine_chunks()
        found, where = np.unique(told.flatten().to_numpy(), return_inverse=True)
        more = group.column("counts").combine_chunks().flatten().to_numpy() - np.repeat(n // 2, told.value_lengths().to_numpy())
        least = common_pages(int(n.sum()))
        found = found[(n // 2).sum() + np.bincount(where, more, len(found)) >= least]
        return pa.Table.from_batches([records([[group.column("host")[0].as_py()], [least], [found]], BOUND)]).slice(0, min(1, len(found)))

    @tidied
    def hits(batches):
        asked = {}

        def pick(rows):
            for k, (host, blocks) in enumerate(zip(column_of(rows, "host").to_pylist(), column_of(rows, "blocks").to_pylist(), strict=True)):
                if host not in asked:
                    asked[host] = column_of(rows, "keys")[k].values.to_numpy().copy()
                runs = np.unique(run_hashes(blocks, host, least_run))
                yield host, runs[np.isin(keys_of(runs), asked[host])]

        yield from tally(batches, pick, lambda counts, n: counts > 0, HITS)

    told = pages.select("host", "blocks").mapInArrow(keys, "host string, pages bigint, runs array<int>, counts array<bigint>")
    asked = durable(told.groupBy("host").applyInArrow(bound, "host string, least bigint, keys array<int>"))
    small = (asked.agg(F.sum(F.size("keys") + 1)).first()[0] or 0) <= most_broadcast
    near = lambda df: F.broadcast(df) if small else df
    found = pages.select("host", "blocks").join(near(asked), "host").mapInArrow(hits, "host string, pages bigint, runs array<bigint>, counts array<bigint>")
    each = found.select("host", F.explode(F.arrays_zip("runs", "counts")).alias("x")).groupBy("host", F.col("x.runs").alias("run")).agg(F.sum("x.counts").alias("count"))
    common = each.join(near(asked.select("host", "least")), "host").where("count >= least")
    return durable(common.groupBy("host").agg(F.collect_list("run").alias("common")))


def extract(pages: DataFrame, least_run: int = 8, most_pages: int = 1000, most_bytes: int = 64_000_000, most_broadcast: int = 100_000) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html).

    Pages are parsed where they are read and dealt by host; ``main_text`` says what stays.
    Pages of a host of more than ``most_pages`` or ``most_bytes`` are not brought together: hashes of their
    runs are counted over the whole host instead, with the same result: the common ones by
    ``common_runs``, and for pages that mark no article all repeated ones by ``shared_runs``.
    Lists of such hosts are broadcast only if they are short. A null or empty html gives an
    empty text, a null url the host without a name; repeated rows stay and count as one
    page; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """

    @tidied
    def read(batches):
        for batch in batches:
            for rows, texts in slices(batch, "html", 4_000_000):
                made = [parse(t) for t in texts]
                yield records([column_of(rows, "page_id"), column_of(rows, "url"), column_of(rows, "host"), [m[0] for m in made], [m[1] for m in made]], PARSED)

    def resolve(group: pa.Table) -> pa.Table:
        made = main_texts(list(zip(group.column("blocks").to_pylist(), group.column("kinds").to_pylist(), strict=True)), least_run)
        return pa.Table.from_arrays([group.column("page_id"), group.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], schema=TEXTS)

    def read_whole(batches):
        for batch in read(batches):
            hosts, blocks, kinds = (column_of(batch, c).to_pylist() for c in ("host", "blocks", "kinds"))
            words = [" ".join(b) for b in blocks]
            content = [xxhash.xxh64_intdigest(f"{h or ''} {w}".encode("utf-8", "surrogatepass")) for h, w in zip(hosts, words, strict=True)]
            yield records([*batch.columns, np.array(content, np.uint64).view(np.int64), [MARKED not in k for k in kinds], [w.count(" ") + 1 for w in words]], WHOLE)

    @tidied
    def finish(batches):
        for batch in batches:
            texts = []
            for host, blocks, kinds, runs in zip(*(column_of(batch, c).to_pylist() for c in ("host", "blocks", "kinds", "runs")), strict=True):
                starts = np.flatnonzero(np.isin(run_hashes(blocks, host, least_run), np.array(runs or [], np.int64))) if runs else np.zeros(0, np.int64)
                texts.append(main_text(blocks, kinds, union_sizes(starts, np.full(len(starts), least_run), sum(b.count(" ") + 1 for b in blocks))))
            yield records([column_of(batch, "page_id"), column_of(batch, "url"), texts, [len(t) for t in texts]], TEXTS)

    fields, made = "page_id bigint, url string, host string, blocks array<string>, kinds array<tinyint>", "page_id bigint, url string, text string, n_chars bigint"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"))
    large = durable(sizes.where((F.col("n") > most_pages) | (F.col("bytes") > most_bytes)).select("host"))
    n_large = large.count()
    near = lambda df: F.broadcast(df) if n_large <= most_broadcast else df
    small = rows.join(near(large), "host", "left_anti").select("page_id", "url", "html", "host").mapInArrow(read, fields).groupBy("host").applyInArrow(resolve, made)
    if not n_large:
        return small
    whole = rows.join(near(large), "host", "left_semi").select("page_id", "url", "html", "host").mapInArrow(read_whole, fields + ", content bigint, bare boolean, n bigint")
    whole = stored(whole.withColumn("place", F.monotonically_increasing_id()))
    columns = ["page_id", "url", "host", "blocks", "kinds"]
    common = common_runs(whole, least_run)
    ready = whole.where("not bare").select(columns).join(near(common), "host", "left").select(*columns, F.col("common").alias("runs"))
    bare = whole.where("bare")
    hosts = durable(bare.select("host").distinct())
    if hosts.count():
        shared = shared_runs(whole.join(near(hosts), "host", "left_semi"), least_run)
        ready = ready.unionByName(bare.join(shared, "content", "left").select(*columns, "runs"))
    return small.unionByName(ready.mapInArrow(finish, made))
