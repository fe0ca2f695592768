"""Main text of web pages by equivalence-class template deduction.

Pages of a host are dealt to blocks of about ``BLOCK`` (a host of any size is many blocks,
so no task holds a whole host; a page's block follows from its host's size and its own key,
not from partitions). A page is a sequence of tokens, tags and words, each with its role:
the path of elements above it. Over the distinct pages of a block every token has an
occurrence vector; tokens with equal vectors are one equivalence class. Of a class, the
tokens that come in one order on every page are valid; a class with too few of them, or on
too few pages, is dropped. Then tokens that occur more often are told apart by the template token
before them, and classes are found again. Valid classes nest: one may lie between two neighbouring tokens
of another, or apart from it, but not across; of classes that cross the one on fewer pages
is dropped. The tokens of the classes that remain are the template; a class of a host's
``SUPPORT`` of pages may hold words, one of tags alone needs ``LEAST_PAGES``, so that every layout counts.

The template's elements are frames, and what is not template inside a frame is its slot. The
slots decide what is extracted: on each page the one with the most words (over the block's pages
that have it, links' words and template words not counted) is the article's, and the
article reaches from there to the nearest element above that holds a heading, unless that
element is the whole page or holds a slot of links or an element that is never an article.
Menus, adverts and footers thereby go without being named. Names only label frames that the
classes have found: a frame of ``OUTSIDE``, or a container all of whose class, id or role is made
of ``NAMES``, is never the article's, nor what is in it. What no class frames stays where it is:
a page with a layout of its own is one slot. Template words outside an article element go. Inside
one whole lines go, if all their words are of classes (found among the articles alone) on
``ARTICLE_SUPPORT`` of the articles, unless such classes are more than ``ARTICLE_SHARE`` of the
articles' words: so copies of an article on one host, or a passage common to many of its pages,
stay whole. The least number of pages of any class is ``LEAST_PAGES``.

A block of fewer than ``LEAST_PAGES`` distinct pages has no classes. There, and there only, every
element of its pages is a frame. Blocks of text: see ``BREAKS``; a br is white space.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect, bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

BLOCK, LEAST_PAGES, LEAST_TOKENS = 64, 3, 3
#: Rows given back at once.
SENT = 500
SUPPORT, ARTICLE_SUPPORT, ARTICLE_SHARE = 0.5, 0.8, 0.25
#: Hosts of more than BLOCK pages whose sizes are broadcast at most; beyond that they are joined by host.
MOST_BROADCAST = 100_000
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template textarea svg math iframe object xmp".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FLOW = frozenset("blockquote dd dl dt figure figcaption h1 h2 h3 h4 h5 h6 li ol p pre table tbody td tfoot th thead tr ul a abbr b cite code em i mark q s small span strong sub sup u".split())
HEADINGS = frozenset("h1 h2 h3".split())
BREAKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that no browser shows as text.
UNSHOWN = frozenset("head title".split())
#: Elements that are never an article's text, if they are the template's.
OUTSIDE = frozenset("head nav footer aside form button select menu dialog title label input canvas audio video".split())
#: Words that say the same of a container if its class, id or role is made of them and of ``PLAIN`` alone.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer form gdpr menu modal nav navbar navigation navigator newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets header masthead topbar".split())
PLAIN = frozenset("area bar block blocks body bottom box button buttons container content global group inner item items js left link links list main outer page post posts right row section site strip the top wrap wrapper".split())
CONTAINERS = frozenset("div section ul ol table header article details figure".split())
_CLOSES_P = BREAKS - {"html", "body"}
_PAGE = frozenset(("", "html", "body"))


def _stable(above: int, what: str) -> int:
    """A 62-bit number for a path, the same in every process."""
    raw = what.encode("utf-8", "replace")
    return ((above * 1000003) ^ (zlib.crc32(raw) << 30) ^ zlib.adler32(raw)) & 0x3FFFFFFFFFFFFFFF


def _named_outside(name: str, named: str) -> bool:
    """Whether an element is never an article's by its name, or a container by each word of a class, id or role."""
    if name in OUTSIDE:
        return True
    if name not in CONTAINERS or not named:
        return False
    for token in named.split():
        parts = set(_PART.findall(token))
        if parts & NAMES and parts <= NAMES | PLAIN:
            return True
    return False


class Roles:
    """The paths of a block's pages: element above, name, and whether it is named as none of an article's."""

    def __init__(self):
        self.of: dict[tuple[int, str], int] = {}
        self.above: dict[int, int] = {0: 0}
        self.name: dict[int, str] = {0: ""}
        self.named: dict[int, bool] = {0: False}
        self.article: dict[int, bool] = {0: False}
        self.link: dict[int, bool] = {0: False}
        self.within: dict[int, list[int]] = defaultdict(list)
        self.ids: dict[tuple[int, str], int] = {}  # tokens with their roles, numbered

    def enter(self, above: int, name: str, named: str) -> int:
        what = f"{name} {named}"
        role = self.of.get((above, what))
        if role is None:
            role = self.of[above, what] = _stable(above, what)
            if role not in self.above:
                self.above[role], self.name[role] = above, name
                article = self.article[above] or name in ("article", "main") or "main" in named.split()
                self.named[role] = not article if name == "header" else name not in _PAGE and _named_outside(name, named)
                self.article[role] = article
                self.link[role] = self.link[above] or name == "a"
                self.within[above].append(role)
        return role


def parse(page: str, roles: Roles) -> list[tuple]:
    """Tokens of a page in one pass over it: (role, tag, text, breaks); the tag is "" for text, else its element's.

    A tag that never ends has no closing bracket for its quotes: from there on quotes are not heeded, so that
    malformed pages take linear time; without any bracket the rest of the page is dropped.
    """
    out: list[tuple] = []
    stack: list[tuple[str, int]] = [("", 0)]
    open_: Counter = Counter()
    at, n, quotes = 0, len(page), True

    def cut(depth: int) -> None:
        for name, _ in stack[depth:]:
            open_[name] -= 1
        del stack[depth:]

    while at < n:
        if page[at] != "<":
            to = page.find("<", at)
            to = n if to < 0 else to
            out.append((stack[-1][1], "", page[at:to], False))
            at = to
            continue
        nxt = page[at + 1 : at + 2]
        if nxt in ("!", "?") or (nxt == "/" and not page[at + 2 : at + 3].isalpha()):
            for start, end in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if page.startswith(start, at):
                    to = page.find(end, at + len(start))
                    at = n if to < 0 else to + len(end)
                    break
            continue
        m = _TAG.match(page, at) if quotes and (nxt == "/" or nxt.isascii() and nxt.isalpha()) else None
        if m and page[m.end() : m.end() + 1] == ">":
            closing, name, rest, at = m[1], m[2].lower(), m[3], m.end() + 1
        elif nxt == "/" or nxt.isascii() and nxt.isalpha():
            quotes = quotes and m is not None and m.end() < n
            to = page.find(">", at)
            if to < 0:
                break
            m = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", page[at:to])
            closing, name, rest, at = m[1] if m else "", (m[2] if m else "").lower(), page[at + m.end() : to] if m else "", to + 1
            if not m:
                continue
        else:
            out.append((stack[-1][1], "", "<", False))
            at += 1
            continue
        breaks = name in BREAKS
        if closing:
            if name == "p" and not open_["p"]:
                out.append((stack[-1][1], "/p", None, True))
            elif open_[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                role = stack[depth][1]
                cut(depth)
                out.append((role, "/" + name, None, breaks))
            continue
        if name in RAW:
            if not rest.rstrip().endswith("/"):
                end = RAW[name].search(page, at)
                at = n if end is None else end.end()
            continue
        if (name in _CLOSES_P or name == "li") and (open_["p"] or (name == "li" and open_["li"])):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p" or (name == "li" and stack[depth][0] == "li"):
                    cut(depth)
                    break
                if stack[depth][0] in BREAKS:
                    break
        named = ""
        if "=" in rest:
            named = " ".join((k.lower() + " " if k.lower() == "role" else "") + (a or b or c).lower() for k, a, b, c in _NAMED.findall(rest))
        role = roles.enter(stack[-1][1], name, named)
        out.append((role, name, None, breaks or name == "br"))
        if name not in VOID and not rest.rstrip().endswith("/"):
            stack.append((name, role))
            open_[name] += 1
    return out


def _keys(tokens: list[tuple], roles: Roles) -> np.ndarray:
    """The numbers of a page's tokens in its order; a tag's token has a bracket."""
    out, ids = [], roles.ids
    for role, tag, text, _ in tokens:
        for k in [(role, "<" + tag)] if text is None else [(role, w) for w in text.split()]:
            found = ids.get(k)
            if found is None:
                found = ids[k] = len(ids)
            out.append(found)
    return np.array(out, np.int64)


def _increasing(order: list[int], line: list[int]) -> list[int]:
    """The longest run of tokens of ``order`` that ``line`` has in the same order."""
    place = {t: i for i, t in enumerate(line)}
    tails: list[int] = []
    last: list[int] = []
    back: dict[int, int | None] = {}
    for t in order:
        i = bisect_left(tails, place[t])
        back[t] = last[i - 1] if i else None
        if i == len(tails):
            tails.append(place[t])
            last.append(t)
        else:
            tails[i], last[i] = place[t], t
    t, run = last[-1] if last else None, []
    while t is not None:
        run.append(t)
        t = back[t]
    return run[::-1]


def _in_order(lines: list[list[int]], turns: int = 16) -> list[int]:
    """The tokens that come in one order on all lines (each has every token once): turn by turn those go that are out
    of order on the most lines; what is then left out of order goes line by line."""
    kept = lines[0]
    for _ in range(turns):
        off: Counter = Counter()
        for line in lines[1:]:
            if line != kept:
                off.update(set(kept).difference(_increasing(kept, line)))
        if not off:
            return kept
        most = max(off.values())
        gone = {t for t, n in off.items() if n == most}
        lines = [[t for t in line if t not in gone] for line in lines]
        kept = lines[0]
    for line in lines[1:]:
        kept = _increasing(kept, line)
    return kept


def classes(sequences: list[np.ndarray], least: float) -> set[int]:
    """The tokens of the valid classes that are on ``least`` pages or more and do not cross."""
    many, lengths = len(sequences), [len(s) for s in sequences]
    token, which = np.unique(np.concatenate(sequences), return_inverse=True)
    page = np.repeat(np.arange(many), lengths)
    cell, times = np.unique(which * many + page, return_counts=True)
    starts = np.flatnonzero(np.diff(cell // many, prepend=-1))
    ends = np.append(starts[1:], len(cell))
    by_vector: dict[tuple, list[int]] = defaultdict(list)
    for t in np.flatnonzero(ends - starts >= least).tolist():
        at = slice(starts[t], ends[t])
        by_vector[(cell[at] % many).tobytes(), times[at].tobytes()].append(t)
    large = [(v, keys) for v, keys in by_vector.items() if len(keys) >= LEAST_TOKENS]
    of = np.full(len(token), -1)
    for c, (_, keys) in enumerate(large):
        of[keys] = c
    first = np.cumsum([0, *lengths])
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in range(many)] for _ in large]
    at = np.flatnonzero(of[which] >= 0)
    for c, p, place, t in zip(of[which[at]].tolist(), page[at].tolist(), (at - first[page[at]]).tolist(), which[at].tolist(), strict=True):
        found[c][p].append((place, t))
    order: dict[int, list[int]] = {}
    for c, (_, keys) in enumerate(large):
        lines = [[t for _, t in x] for x in found[c] if x]
        if max(map(len, lines)) == len(keys) == len(set(lines[0])):
            line = _in_order(lines)
        else:  # several rounds on a page: all in one order, or the class is none
            line = lines[0][: len(keys)]
            if len(set(line)) < len(keys) or any(x != line * (len(x) // len(keys)) for x in lines):
                continue
        if len(line) >= LEAST_TOKENS:
            order[c] = line
            if len(line) < len(keys):
                valid = set(line)
                found[c] = [[x for x in places if x[1] in valid] for places in found[c]]
    kept: list[int] = []
    for c in sorted(order, key=lambda c: (-len(large[c][0][0]), -len(order[c]), large[c][0])):
        if all(_nests(found[c], len(order[c]), found[k], len(order[k])) for k in kept):
            kept.append(c)
    return {int(token[t]) for c in kept for t in order[c]}


def _nests(inner: list, n: int, outer: list, m: int) -> bool:
    """Whether each round of the one lies between two tokens of the other, or apart from it, on every page."""
    for x, y in zip(inner, outer, strict=True):
        if not x or not y:
            continue
        places = [at for at, _ in y]
        if all(bisect(places, x[i][0]) == bisect(places, x[i + n - 1][0]) for i in range(0, len(x), n)):
            continue
        places = [at for at, _ in x]
        if not all(bisect(places, y[i][0]) == bisect(places, y[i + m - 1][0]) for i in range(0, len(y), m)):
            return False
    return True


def _with_gaps(sequence: np.ndarray, first: np.ndarray, tokens: int) -> np.ndarray:
    """Each token's number with that of the template token before it; template tokens as they are."""
    own = first[sequence]
    last = np.maximum.accumulate(np.where(own, np.arange(len(sequence)), -1)) if len(sequence) else sequence
    return np.where(own, sequence, (1 + np.where(last >= 0, sequence[last], -1)) * tokens + tokens + sequence)


def deduce(sequences: list[np.ndarray], least: float, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``tokens`` are the template's, and (sorted) which are that only behind one of them: a token that occurs
    more often than others of its class is told apart by the template token before it, and classes are found again."""
    first = np.zeros(tokens, bool)
    first[list(classes(sequences, least))] = True
    if not first.any():
        return first, np.zeros(0, np.int64)
    pages = np.bincount(np.concatenate([np.unique(s) for s in sequences]), minlength=tokens)
    again = classes([_with_gaps(s, first, tokens)[pages[s] >= least] for s in sequences], least)
    return first, np.array(sorted(k for k in again if k >= tokens), np.int64)


def marks(sequence: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which tokens of a page are template."""
    first, second = found
    out = first[sequence]
    return out | np.isin(_with_gaps(sequence, first, len(first)), second) if len(second) else out


class Template:
    """What a block's pages share, and where their articles are.

    For each page ``general`` marks its tokens (as ``_keys`` gives them) that are template, ``strict`` those that go
    inside articles too. ``frames`` are roles, ``out``
    whether a role is in a frame that is named as none of an article's, ``score`` the words of a page's slot of each
    frame, ``links`` frames of links.
    """

    def __init__(self, roles: Roles, pages: list[list[tuple]]):
        self.roles = roles
        sequences = [_keys(p, roles) for p in pages]
        distinct = list({s.tobytes(): s for s in sequences}.values())
        keys = list(roles.ids)
        n = len(keys)
        tag = np.array([t[0] == "<" for _, t in keys], bool)
        every = list(roles.above)
        at_role = {r: i for i, r in enumerate(every)}
        of = np.array([at_role[r] for r, _ in keys], np.int64)
        found, tags = (np.zeros(n, bool), np.zeros(0, np.int64)), set()
        if deduced := len(distinct) >= LEAST_PAGES:
            found = deduce(distinct, max(LEAST_PAGES, SUPPORT * len(distinct)), n)
            tags = classes([s[tag[s]] for s in distinct], LEAST_PAGES)
        self.general = [marks(s, found) for s in sequences]
        self.strict = [np.zeros(len(s), bool) for s in sequences]
        article = np.array([roles.article[r] for r in every], bool)[of]
        articles = [x for x in (s[article[s]] for s in distinct) if not tag[x].all()]
        if len(articles) >= LEAST_PAGES:
            inside = deduce(articles, max(LEAST_PAGES, ARTICLE_SUPPORT * len(articles)), n)
            gone = sum(int((marks(x, inside) & ~tag[x]).sum()) for x in articles)
            if gone <= ARTICLE_SHARE * sum(int((~tag[x]).sum()) for x in articles):
                for s, out in zip(sequences, self.strict, strict=True):
                    at = np.flatnonzero(article[s])
                    out[at] = marks(s[at], inside)
        self.tokens = {keys[i] for i in (*np.flatnonzero(found[0]).tolist(), *tags)}
        self.frames = {0} | {r for r, t in self.tokens if t == "<" + roles.name[r]}
        if not deduced:
            self.frames.update(r for r in every if roles.name[r] in BREAKS)
        self.framed: dict[int, int] = {}
        self.out: dict[int, bool] = {}
        for r in every:  # those above come first
            self.out[r] = self.out.get(roles.above[r], False) or roles.name[r] in UNSHOWN or (r in self.frames and roles.named[r])
        self.headed: set[int] = set()  # elements that hold a heading, at any depth
        for r, name in roles.name.items():
            while name in HEADINGS and not self.out[r] and r not in self.headed:
                self.headed.add(r)
                r = roles.above[r]
        self._weigh(every, [of[s[~tag[s] & ~m]] for s, m in zip(sequences, self.general, strict=True)])
        if not any(self.score.values()):  # all is template, as on near copies of one page
            self._weigh(every, [of[s[~tag[s]]] for s in sequences])

    def frame(self, role: int) -> int:
        """The frame that a role stands in. Paths are walked once, as pages may nest without end."""
        path = []
        while role not in self.frames and role not in self.framed:
            path.append(role)
            role = self.roles.above[role]
        found = role if role in self.frames else self.framed[role]
        self.framed.update(dict.fromkeys(path, found))
        return found

    def _weigh(self, every: list[int], pages: list[np.ndarray]) -> None:
        """Scores of frames, from the roles (places in ``every``) of each page's words that count."""
        roles = self.roles
        words: Counter = Counter()
        linked: Counter = Counter()
        on: Counter = Counter()
        for page in pages:
            seen = set()
            for i, n in zip(*(x.tolist() for x in np.unique(page, return_counts=True)), strict=True):
                role = every[i]
                f = self.frame(role)
                if self.out[role] and not self.out[f]:
                    continue
                seen.add(f)
                (linked if roles.link[role] else words)[f] += n
            on.update(seen)
        self.links = {f for f, n in linked.items() if n > words[f]}
        self.score = {f: words[f] / on[f] for f in on if f not in self.links and not self.out[f]}

    def region(self, frame: int) -> int:
        """The element that the article of a slot reaches up to."""
        roles, role = self.roles, frame
        while roles.name[role] in FLOW and roles.above[role] != role:
            role = roles.above[role]
        up = role
        while up not in self.headed:
            up = roles.above[up]
            if roles.name[up] in _PAGE or self._mixed(up):
                return role
        return up

    def _mixed(self, role: int) -> bool:
        return any(self.out[r] or r in self.links for r in self.roles.within.get(role, ()))


def slots_text(tokens: list[tuple], template: Template, page: int) -> str:
    """The article in the slots of a page, the block's ``page``-th."""
    roles = template.roles
    frames = {template.frame(role) for role, _, text, _ in tokens if text is not None and not template.out[role] and not text.isspace()}
    ranked = sorted((f for f in frames if f in template.score), key=lambda f: (-template.score[f], f))
    for f in ranked or sorted(frames):  # where all is template words or links, whatever there is
        text = _text_in(tokens, template, page, template.region(f))
        if text:
            return text
    return ""


def _text_in(tokens: list[tuple], template: Template, page: int, region: int) -> str:
    roles = template.roles
    page_wide = roles.name[region] in ("html", "body") or (region and template._mixed(region))
    wanted: dict[int, bool] = {region: True}

    def want(role: int) -> bool:
        path = []
        while role not in wanted:
            path.append(role)
            if role == roles.above[role] or template.out[role] or (role in template.links and roles.name[role] not in FLOW):
                wanted[role] = False
            role = roles.above[role]
        found = wanted[role]
        for r in reversed(path):
            # of a whole page, or a part with a menu in it, only the text elements next to the article
            found = wanted.setdefault(r, found and (not page_wide or roles.above[r] != region or roles.name[r] in FLOW))
        return found

    blocks: list[str] = []
    run: list[str] = []
    count = [0, 0]  # words of a line, and those that are an article's template
    general, strict, at = template.general[page], template.strict[page], 0

    def close() -> None:
        line = " ".join(html.unescape("".join(run)).split())
        if line and count[1] < count[0]:
            blocks.append(line)
        run.clear()
        count[:] = 0, 0

    for role, tag, text, breaks in tokens:
        if text is None:
            at += 1
            if breaks and tag != "br":
                close()
            elif breaks or tag in ("td", "th", "/td", "/th"):
                run.append(" ")
            continue
        start, at = at, at + len(text.split())
        if want(role):
            gone = general[start:at]
            count[0] += at - start
            if roles.article[role] or roles.name[role] in FLOW:
                count[1] += int(strict[start:at].sum())
            elif gone.any():
                left = iter(gone.tolist())
                text = "".join(w for w in re.split(r"(\s+)", text) if not w or w.isspace() or not next(left))
            run.append(text)
    close()
    return "\n".join(blocks)


def extract(pages: list[str | None]) -> list[str]:
    """The main texts of a block's pages."""
    roles = Roles()
    parsed = [parse(p or "", roles) for p in pages]
    template = Template(roles, parsed)
    return [slots_text(t, template, i) for i, t in enumerate(parsed)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list] = []  # page_id, url, html and the rows that hold just these
    kinds, now = [], None

    def done() -> Iterator[pa.RecordBatch]:
        texts = extract([page for *_, page, _ in held])
        rows: list[tuple] = []
        for (page_id, url, _, n), text in zip(held, texts, strict=True):
            for at in range(0, n, SENT):
                rows += [(page_id, url, text, len(text))] * min(SENT, n - at)
                if len(rows) >= SENT:
                    yield sent(rows)
                    rows = []
        yield sent(rows)

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kinds[0], pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "text", "n_chars"])

    for b in batches:
        kinds = [b["page_id"].type]
        host, block = b["host"], b["block"].to_pylist()
        for i in range(b.num_rows):
            key, row = (host[i].as_py(), block[i]), [b[c][i].as_py() for c in ("page_id", "url", "html")]
            if held and key != now:
                yield from done()
                held.clear()
            now = key
            if held and held[-1][:3] == row:  # repeated rows stand side by side
                held[-1][3] += 1
            else:
                held.append([*row, 1])
    if held:
        yield from done()


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text; null urls are one host; repeated rows are
    pages of their own with equal texts, and count once for the template; a block of fewer than LEAST_PAGES distinct
    pages is read by its own elements; pages of any length are
    taken whole, in time linear in it; ties between slots go to the smaller path number; other
    columns, whatever their names, are not read; an empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"://([^/?#]*)", 1))
    kind = pages.schema["page_id"].dataType.simpleString()
    sizes = saved(pages.groupBy(host.alias("host")).count().filter(F.col("count") > BLOCK).select("host", F.ceil(F.col("count") / BLOCK).alias("blocks")), "hosts")
    few = sizes.count() <= MOST_BROADCAST
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), F.xxhash64("page_id", "url", "html").alias("deal"))
    rows = rows.join(F.broadcast(sizes) if few else sizes.hint("merge"), "host", "left")
    rows = rows.withColumn("block", F.pmod("deal", F.coalesce("blocks", F.lit(1))))
    rows = rows.repartition("host", "block").sortWithinPartitions("host", "block", "deal")
    return rows.select("page_id", "url", "html", "host", "block").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
