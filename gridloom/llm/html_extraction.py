"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A block is the text between two boundaries of block-level elements. Its features are the tags and the words of class,
id and role of the elements around it, measures of its text, the words of short blocks, and how the elements around it
stand to the page: the share of its text that they hold, whether they hold the headline, and how often they are repeated.
The field has two labels, main text and other, and is trained on labelled pages: a sample of the table's pages labelled
by their own semantic elements, and pages that are laid out in other known ways around text of that sample. Decoding is
Viterbi's.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

#: Pages of the table in the training sample (about), pages laid out in other ways, blocks of a stretch of a training
#: page (longer pages are trained on in several), steps and rate of the training, weight of the penalty on size.
SAMPLE_PAGES, LAID_OUT, STRETCH, STEPS, RATE, RIDGE = 200, 900, 120, 200, 0.2, 1e-4

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template textarea svg iframe object math canvas".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the second kind ends where one of the first starts inside the same parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "body": {"html"}}

MARKUP = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*+(?:>|\Z))|[!?/][^>]*+(?:>|\Z))""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW_TAGS}


class Element:
    """A block-level element: its parent, what it looks like, the characters of text in it and up to two levels below,
    whether it holds a headline, and how many elements of its parent look like it."""

    __slots__ = ("parent", "look", "chars", "headed", "alike", "stamped", "inner")

    def __init__(self, parent, look):
        self.parent, self.look, self.chars, self.headed, self.alike, self.stamped, self.inner = parent, look, 0, False, None, False, None


class Block:
    __slots__ = ("text", "context", "linked", "own")

    def __init__(self, text: str, context: tuple[str, ...], linked: int, own: Element):
        self.text, self.context, self.linked, self.own = text, context, linked, own


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks with text, in page order; references are decoded, and white space is one space."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    top = Element(None, "")
    elements = [top]
    everything = [top]  # keeps elements alive, so that no two have one id
    children: dict[tuple[int, str], list[int]] = {}
    around: Counter = Counter()
    opened: Counter = Counter()  # block-level elements that are open, by tag, and others since the last of those
    inline: list[Counter] = [Counter()]
    buffer: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                tag = next((t for t, _ in reversed(stack) if t in BLOCK_TAGS), "")
                own = elements[-1]
                found.append(Block(text, (f"tag:{tag}", *around), linked, own))
                up = own
                for _ in range(3):
                    if up is not None:
                        up.chars += len(text) - min(linked, len(text))
                        up = up.parent
                if tag == "h1":
                    for e in reversed(elements):
                        if e.headed:
                            break
                        e.headed = True
            buffer.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag, names = stack.pop()
            links -= tag == "a"
            if tag in BLOCK_TAGS:
                elements.pop()
                opened[tag] -= 1
                inline.pop()
            else:
                inline[-1][tag] -= 1
            for name in names:
                around[name] -= 1
                if not around[name]:
                    del around[name]

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at:
            buffer.append(page[at:end])
            if links:
                linked += end - at

    size = len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            text_until(size)
            break
        text_until(m.start())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if m["end"]:
            if not (opened if block else inline[-1])[tag]:
                continue  # it ends nothing
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if not block and stack[k][0] in BLOCK_TAGS:
                    break
            continue
        if tag in RAW_TAGS:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in VOID_TAGS or m["attributes"].endswith("/>") and tag not in BLOCK_TAGS:
            continue
        if block:
            for k in range(len(stack) - 1, -1, -1):
                open_tag = stack[k][0]
                if open_tag == "p" or open_tag in ENDS.get(tag, ()):
                    pop_to(k)
                    if open_tag != "p":
                        break
                elif open_tag in BLOCK_TAGS and (tag not in HOLDS or open_tag in HOLDS[tag]):
                    break
        names: tuple[str, ...] = ()
        if block:
            words = {w for n in NAMES.findall(m["attributes"]) for w in WORD.findall("".join(n).lower()) if not w.isdigit()} if "=" in m["attributes"] else ()
            names = (f"in:{tag}", *(f"name:{w}" for w in sorted(words)))
            around.update(names)
            parent, look = elements[-1], " ".join(names)
            alike = children.setdefault((id(parent), look), [0])
            alike[0] += 1
            elements.append(Element(parent, look))
            elements[-1].alike = alike
            everything.append(elements[-1])
        links += tag == "a"
        if block:
            opened[tag] += 1
            inline.append(Counter())
        else:
            inline[-1][tag] += 1
        stack.append((tag, names))
    flush()
    return found


def share(part: float, whole: float) -> int:
    """0 for none, 1 for less than a quarter, and so on to 5 for nearly all."""
    return 0 if part <= 0 else min(1 + int(4 * part / max(whole, 1)), 5) if part < 0.95 * whole else 5


#: What says when or by whom something was said, or answers it, in short blocks.
STAMP = re.compile(r"\b\d+ ?(?:s|m|h|d|min|mins|minutes?|hours?|days?|weeks?|months?|years?|likes?) ?(?:ago)?\b|\b\d{1,2}:\d\d\b|\b\d{4}-\d\d?-\d\d?\b|\b(?:yesterday|gestern|hier|ayer|vor \d|il y a|hace \d|reply|antworten|répondre|responder|quote|permalink|flag|report|like)\b|\b\d{1,2} [A-Z]\w+ \d{4}\b|\b[A-Z][a-z]{2,8} \d{1,2}, \d{4}\b", re.I)


#: Elements that say what they are for.
TELLING_TAGS = frozenset("article main aside nav form footer header figure li table blockquote dialog section".split())


def closest(own: Element) -> list[str]:
    """The telling element next above a block, and the names of the two elements next to it."""
    inner, e = own.inner, own
    if inner is None:
        way = []
        while e.inner is None:
            way.append(e)
            tag = e.look[3:].split(" ", 1)[0]
            if e.parent is None or tag in TELLING_TAGS:
                e.inner = f"inner:{tag}"
            else:
                e = e.parent
        inner = e.inner
        for e in way:
            e.inner = inner
    up = own.parent or own
    return [*near_names(own.look)[0], *near_names(up.look)[1], inner]


@functools.lru_cache(4096)
def near_names(look: str) -> tuple[list[str], list[str]]:
    """Features of an element next to a block, all and those of names alone."""
    words = look.split()
    return [f"near:{w}" for w in words], [f"near:{w}" for w in words if w.startswith("name:")]


def stamps(own: Element) -> list[str]:
    """How the element of a block, and those around it, are stamped and repeated."""
    up = own.parent or own
    over = up.parent or up
    alike = [f"{min(e.alike[0], 3) if e.alike else 0}{e.stamped}" for e in (own, up, over)]
    return [f"stamped:{'-'.join(alike)}", f"stamped0:{alike[0]}", f"stamped1:{alike[1]}"]


WIDE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")


def features(blocks: list[Block]) -> list[list[str]]:
    for b in blocks:  # an element with a stamp, and the one that it is repeated in
        if len(b.text) <= 60 and STAMP.search(b.text):
            up = b.own
            for _ in range(2):
                if up.parent is not None:
                    up.stamped, up = True, up.parent
    total = sum(len(b.text) - min(b.linked, len(b.text)) for b in blocks)
    headed = any("tag:h1" in b.context for b in blocks)
    held = any("in:article" in b.context or "in:main" in b.context for b in blocks)
    most = max((len(b.text) for b in blocks), default=0)
    result = []
    for b in blocks:
        size = len(b.text)
        # a character of a script without spaces counts as half a word, and as three of another
        wide = 0 if b.text.isascii() else len(WIDE.findall(b.text))
        words = b.text.count(" ") + 1 + wide // 2
        stops = sum(map(b.text.count, ".,。，、"))
        up = b.own.parent or b.own
        over = up.parent or up
        near = 3 if not headed else 0 if b.own.headed or up.headed else 1 if over.headed else 2
        inside = not held or "in:article" in b.context or "in:main" in b.context
        found = [
            "bias", *b.context, f"size:{min((size + 2 * wide).bit_length(), 12)}", f"words:{min(words.bit_length(), 8)}", f"stops:{min(stops.bit_length(), 5)}",
            f"link:{min(4 * b.linked // max(size, 1), 4)}", f"sign:{'©' in b.text or 'copyright' in b.text.lower()}",
            f"head:{near}", f"inside:{inside}", f"up:{share(up.chars, total)}", f"over:{share(over.chars, total)}", f"of:{share(size, most)}",
            f"alike:{min(up.alike[0] if up.alike else 0, 3)}", f"above:{min(over.alike[0] if over.alike else 0, 3)}", f"held:{inside and held}:{near}", *stamps(b.own), *closest(b.own), f"{b.context[0]}:{inside and held}", f"header:{'in:header' in b.context}:{inside and held}:{near}",
        ]
        if words <= 8:
            found += [f"word:{w}" for w in set(WORD.findall(b.text.lower())) if not w.isdigit()]
            found.append(f"digits:{any(map(str.isdigit, b.text))}")
        result.append(found)
    return result


class Field:
    """weights: of each feature for the label main (other has 0); moves[a][b]: of label b after a; start: of main."""

    def __init__(self, weights: dict[str, float], moves, start: float):
        self.weights, self.moves, self.start = {k: float(w) for k, w in weights.items()}, [list(map(float, r)) for r in moves], float(start)

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi's labels: whether each block is main text."""
        if not blocks:
            return []
        get, m = self.weights.get, self.moves
        back = []
        a = b = 0.0
        for k, names in enumerate(features(blocks)):
            e = 0.0
            for name in names:
                e += get(name, 0.0)
            if not k:
                a, b = 0.0, self.start + e
                continue
            stay, leave = a + m[0][0], b + m[1][0]
            enter, keep = a + m[0][1], b + m[1][1]
            back.append((leave > stay, keep >= enter))
            a, b = max(stay, leave), max(enter, keep) + e
        label = b >= a
        labels = [label]
        for from_main in reversed(back):
            label = from_main[label]
            labels.append(label)
        return labels[::-1]


def train_field(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS) -> Field:
    """Maximises the conditional log-likelihood less the penalty by gradient steps (Adam's) over all pages at once; a page of
    more than STRETCH blocks is as many chains as it takes."""
    whole = [(features(b), labels) for b, labels in pages]
    named = [f[k : k + STRETCH] for f, _ in whole for k in range(0, len(f), STRETCH)]
    pages = [(None, labels[k : k + STRETCH]) for f, labels in whole for k in range(0, len(f), STRETCH)]
    counts = Counter(name for page in named for names in page for name in set(names))
    index = {name: k for k, name in enumerate(sorted(n for n, c in counts.items() if c))}
    n, most = len(pages), max((len(p) for p in named), default=0)
    if not n or not index:
        return Field({}, [[0, 0], [0, 0]], 0)
    rows, cols = [], []
    y, there = np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (page, (_, labels)) in enumerate(zip(named, pages)):
        there[i, : len(page)] = True
        y[i, : len(page)] = labels
        for t, names in enumerate(page):
            own = {index[x] for x in names if x in index}
            rows += [i * most + t] * len(own)
            cols += own
    rows, cols, d = np.array(rows), np.array(cols), len(index)
    theta = np.zeros(d + 5)
    first = second = np.zeros(d + 5)
    total = there.sum()
    for step in range(1, steps + 1):
        e = np.bincount(rows, theta[cols], n * most).reshape(n, most)
        moves, start = theta[d : d + 4].reshape(2, 2), theta[d + 4]
        emit = np.stack([np.zeros_like(e), e], axis=2)
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = emit[:, 0] + [0, start]
        for t in range(1, most):
            forward[:, t] = np.where(there[:, t, None], np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + emit[:, t], forward[:, t - 1])
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(most - 2, -1, -1):
            backward[:, t] = np.where(there[:, t + 1, None], np.logaddexp.reduce(moves + (emit[:, t + 1] + backward[:, t + 1])[:, None], axis=2), 0)
        p = np.exp(forward + backward - z[:, None, None])[:, :, 1] * there
        gradient = np.zeros(d + 5)
        gradient[:d] = np.bincount(cols, ((y - p) * there).ravel()[rows], d)
        both = there[:, 1:]
        pair = np.exp(forward[:, :-1, :, None] + moves + (emit[:, 1:] + backward[:, 1:])[:, :, None] - z[:, None, None, None]) * both[:, :, None, None]
        seen = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                seen[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum()
        gradient[d : d + 4] = (seen - pair.sum(axis=(0, 1))).ravel()
        gradient[d + 4] = (y[:, 0] - p[:, 0]).sum()
        gradient = gradient / total - RIDGE * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field({name: theta[k] for name, k in index.items()}, theta[d : d + 4].reshape(2, 2), theta[d + 4])


#: Words of class, id and role that mark what isn't main text, and those that mark main text.
OTHER_NAMES = (
    "ad ads advert advertisement banner sponsor sponsored promo nav navigation navbar menu breadcrumb breadcrumbs header masthead footer foot copyright "
    "sidebar aside widget related recommended share social comment comments disqus reply replies cookie cookies consent notice popup modal newsletter "
    "subscribe signup login form search pagination pager tags toolbar legal complementary contentinfo"
).split()
MAIN_NAMES = "content article post entry main story body text articlebody".split()
OTHER_TAGS = frozenset("nav footer aside form title head button select option label menu dialog".split())
#: What short blocks of menus, notices, forms and comments say, in layouts.
HEADINGS = "Comments|3 comments|Leave a reply|Responses|Discussion|What readers say|Kommentare|Commentaires|Comentarios|Join the conversation|Opinions|Your views|12 thoughts".split("|")
STAMPS = "2 hours ago|5 min ago|yesterday|2024-03-05|3 days ago|12 March 2023|vor 2 Stunden|il y a 3 jours|hace 2 horas|10:42|Jan 4, 2022 at 9:15".split("|")
ANSWERS = "Reply|Like|Report|Antworten|Répondre|Responder|Quote|Permalink|Share|Flag|12 likes".split("|")
NAMES_OF_PEOPLE = "Ann|bob77|J. Smith|Maria|kai_92|Tom B.|Lena|anonymous|User 4411|Chloé|Ivan|reader_1".split("|")
NOTICES = "We use cookies to improve your visit.|Subscribe to our newsletter|Sign up|Log in|Accept all|Advertisement|Sponsored|Related articles|Read more|Share this|Follow us|Most read|Tags|Back to top|All rights reserved|Home|Contact|Privacy policy|Search".split("|")
MAIN = "\ue000"


def semantic_labels(blocks: list[Block]) -> list[bool] | None:
    """Main are blocks in an article or main element and in none that marks something else (a header in an article is
    the article's own); None if there are none."""
    found = []
    for b in blocks:
        tags = {c[3:] for c in b.context if c.startswith("in:")}
        names = {c[5:] for c in b.context if c.startswith("name:")}
        found.append(bool(tags & {"article", "main"}) and not tags & OTHER_TAGS and not names & set(OTHER_NAMES))
    return found if any(found) else None


def laid_out(texts: list[str], number: int, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    """Labelled pages: text of the sample in layouts with and without semantic elements and telling names, alone or among
    menus, notices, forms, sidebars, adverts, footers and comments. A sign marks the main text till the blocks are cut."""
    rng = random.Random(seed)
    long_texts = [t for t in texts if len(t) > 60] or ["Some words of a text that go on for a while, and then they end here."]
    words = [w for t in long_texts for w in t.split()]

    def phrase(low: int, high: int) -> str:
        start = rng.randrange(max(1, len(words) - high))
        return html.escape(" ".join(words[start : start + rng.randint(low, high)]))

    def name() -> str:
        """A word that says nothing."""
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))

    def attribute(names: list[str], telling: float) -> str:
        picked = rng.sample(names, rng.choice((1, 1, 2))) if rng.random() < telling else [name() for _ in range(rng.choice((1, 1, 2)))]
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice("- _").join(picked)}"' if rng.random() < 0.85 else ""

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{rng.choice((phrase(1, 3), rng.choice(NOTICES)))}</a></li>' for _ in range(n)) + "</ul>"

    def varied(t: str) -> str:
        """t, or t cut off, without stops, or in a script that has no spaces: how a text ends says little."""
        kind = rng.random()
        if kind < 0.25:
            own = t.split()
            return " ".join(own[: rng.randint(min(5, len(own)), len(own))]).rstrip(".!?:;,") or t
        if kind < 0.35:
            return t.replace(".", "").replace(",", "")
        if kind < 0.5:
            first, n = rng.choice(((0x4E00, 4000), (0x3041, 80), (0x0430, 32), (0x0627, 30), (0xAC00, 2000))), rng.randint(20, 160)
            return "".join(rng.choice((" ", "。", "，")) if rng.random() < 0.06 else chr(first[0] + rng.randrange(first[1])) for _ in range(n)).strip() + rng.choice(("", "", "。", "."))
        return t

    def line(low: int, high: int) -> str:
        """What isn't main text may read like it."""
        return phrase(low, high) if rng.random() < 0.5 else html.escape(varied(rng.choice(long_texts)))

    def paragraphs(n: int) -> str:
        return "".join(f"<p>{line(4, 60)}</p>" for _ in range(n))

    def comments() -> str:
        item, box = rng.choice(("li", "div", "div", "article", "p")), rng.choice(("section", "div", "div", "ol", "aside"))
        own, by = attribute(["comment", "reply", "comments"], 0.4), rng.choice("pdbs")
        parts = ""
        for _ in range(rng.randint(1, 6)):
            who = html.escape(rng.choice(NAMES_OF_PEOPLE))
            head = {"p": f"<p><b>{who}</b> {rng.choice(STAMPS)}</p>", "d": f"<div{own}>{who}</div><div>{rng.choice(STAMPS)}</div>", "b": f"<b>{who}</b>: ", "s": f"<h4>{who}</h4>"}[by]
            said = line(3, 60) if item == "p" or by == "b" else f"<{(q := rng.choice(('p', 'p', 'div')))}>{line(3, 60)}</{q}>"
            parts += f"<{item}{own}>{head}{said}{rng.choice(('', f'<a href=#r>{rng.choice(ANSWERS)}</a>', f'<button>{rng.choice(ANSWERS)}</button>', f'<div>{rng.choice(ANSWERS)}</div>'))}</{item}>"
        title = f"<{(h := rng.choice(('h2', 'h3', 'h4', 'div')))}>{rng.choice(HEADINGS)}</{h}>" * (rng.random() < 0.7)
        return f"<{box}{attribute(['comments', 'comment', 'discussion', 'disqus', 'replies'], 0.4)}>{title}{parts}</{box}>"

    def others(inside: bool = False) -> str:
        telling = lambda: attribute(OTHER_NAMES, 0.7)
        kinds = [
            lambda: f"<aside{attribute(OTHER_NAMES, 0.3)}><h3>{rng.choice((phrase(1, 4), rng.choice(NOTICES)))}</h3>{rng.choice((links(4), paragraphs(2)))}</aside>",
            lambda: f"<form><label>{phrase(1, 3)}</label><{(q := rng.choice(('p', 'p', 'div')))}>{rng.choice((line(3, 40), line(3, 12), rng.choice(NOTICES)))}</{q}><button>{rng.choice(NOTICES)}</button></form>",
            lambda: f"<div{attribute(OTHER_NAMES, 1)}>{rng.choice((line(3, 40), line(3, 40), rng.choice(NOTICES)))}</div>",
            *[lambda: f'<div class="{rng.choice(("ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo"))}{rng.choice("-_ ")}{rng.choice((name(), "box", "slot", "1"))}">{rng.choice((line(3, 40), paragraphs(1)))}</div>'] * 2,
            *[lambda: f"<aside{attribute(OTHER_NAMES, 0.2)}>{rng.choice(('', f'<h3>{phrase(1, 4)}</h3>'))}{rng.choice((paragraphs(1), paragraphs(1), line(3, 40)))}</aside>"] * 2,
            lambda: f"<div{attribute(OTHER_NAMES, 1)}>{paragraphs(rng.randint(1, 4))}</div>",
            lambda: f"<section{attribute(OTHER_NAMES, 1)}><h3>{phrase(1, 4)}</h3>{paragraphs(rng.randint(1, 3))}</section>", lambda: f"<div{telling()}>{links(rng.randint(2, 8))}</div>",
            lambda: f"<div{telling()}>{rng.choice(NOTICES)}</div>", lambda: f"<div><h4>{rng.choice(NOTICES)}</h4>{links(rng.randint(2, 5))}</div>", comments, comments,
        ]
        if not inside:
            kinds += [
                lambda: f"<nav>{links(rng.randint(2, 8))}</nav>", lambda: f"<header{telling()}><h1>{phrase(1, 3)}</h1>{links(rng.randint(1, 6))}</header>",
                lambda: f"<header{telling()}><p>{phrase(2, 12)}</p></header>", lambda: f"<header{telling()}><a href=/>{phrase(1, 3)}</a>{rng.choice(('', f'<p>{phrase(2, 9)}</p>', links(4)))}</header>",
                lambda: f"<footer>{rng.choice((f'&copy; {phrase(2, 20)}', links(3), paragraphs(1)))}</footer>",
            ]
        return rng.choice(kinds)()

    def text(t: str) -> str:
        return MAIN + html.escape(t)

    def body_part(tag: str, paragraph) -> str:
        return rng.choice((paragraph,) * 10 + (
            lambda: f"<h2>{MAIN}{phrase(1, 8)}</h2>", lambda: f"<blockquote>{MAIN}{phrase(5, 50)}</blockquote>", lambda: f"<pre>{MAIN}{phrase(3, 30)}</pre>",
            lambda: f"<{(k := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{MAIN}{phrase(3, 20)}</li>" for _ in range(rng.randint(1, 5))) + f"</{k}>",
            lambda: "<table>" + "".join(f"<tr><td>{MAIN}{phrase(1, 4)}</td><td>{MAIN}{phrase(1, 9)}</td></tr>" for _ in range(3)) + "</table>",
            lambda: f"<{tag}>{MAIN}" + rng.choice((" | ", " ", " - ", ", ")).join(phrase(1, 2) for _ in range(rng.randint(3, 30))) + f"</{tag}>",
            lambda: f"<{tag}>{MAIN}{phrase(1, 3)}</{tag}>", lambda: f"<figure><img src=x><figcaption>{MAIN}{phrase(3, 20)}</figcaption></figure>",
        ))()

    def article() -> str:
        tag = rng.choice(("p", "p", "p", "p", "div"))
        wrap = rng.choice(("", "", "", "div", "section"))
        paragraph = lambda: f"<{tag}>{text(varied(rng.choice(long_texts)))}</{tag}>"
        heading = f"<h1>{MAIN}{phrase(1, 12)}</h1>" if rng.random() < 0.75 else ""
        if rng.random() < 0.3:
            by = rng.choice((f"<p>{MAIN}By {phrase(1, 3)}</p>", f"<p>{MAIN}{phrase(1, 3)}, {rng.choice(STAMPS)}</p>", f"<div>{MAIN}{phrase(2, 5)}</div><time>{MAIN}{rng.choice(STAMPS)}</time>"))
            heading = f"<header>{heading}{by}</header>" if rng.random() < 0.7 else heading + by
        if rng.random() < 0.15:  # one paragraph alone
            return rng.choice(("", heading)) + paragraph()
        parts = [paragraph()] + [body_part(tag, paragraph) for _ in range(rng.choice((0, 0, 1, 2, 4, 8, 16)))]
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            parts.insert(rng.randint(1, len(parts)), others(True))
        inner = "".join(parts)
        return heading + (f"<{wrap}{attribute(MAIN_NAMES, 0.3)}>{inner}</{wrap}>" if wrap else inner) + "".join(others(True) for _ in range(rng.choice((0, 0, 1, 2))))

    pages = []
    for _ in range(number):
        main = article()
        kind = rng.choice(("article", "article", "article", "main", "main", "main", "main article", "div", "div", "div div", "section", "td", ""))
        for tag in reversed(kind.split()):
            own = attribute(MAIN_NAMES, 0.4) if tag in ("div", "section") or rng.random() < 0.4 else ""
            main = f"<table><tr><td{own}>{main}</td></tr></table>" if tag == "td" else f"<{tag}{own}>{main}</{tag}>"
        around = rng.choice((0, 1, 2, 4))
        head = f"<head><title>{phrase(2, 12)}</title></head>" * (rng.random() < 0.7)
        page = f"<html>{head}<body>" + "".join(others() for _ in range(rng.randint(0, around))) + main + "".join(others() for _ in range(rng.randint(0, around))) + "</body></html>"
        blocks = blocks_of(page)
        labels = [MAIN in b.text for b in blocks]
        for b in blocks:
            b.text = " ".join(b.text.replace(MAIN, " ").split())
        pages.append(([b for b in blocks if b.text], [label for b, label in zip(blocks, labels) if b.text]))
    return pages


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, html_col: str = "html") -> Field:
    """From a sample of about sample_pages pages, drawn by the digest of the html, which count three times, and the layouts
    around its text."""
    rows = pages.select(F.col(html_col).cast("string").alias("html")).filter(F.col("html").isNotNull())
    n = rows.count()
    drawn = rows.filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample_pages / max(n, 1)))
    sample = sorted(r["html"] for r in drawn.limit(4 * sample_pages).collect())
    labelled, texts = [], []
    for page in sample:
        blocks = blocks_of(page)
        texts += [b.text for b in blocks]
        labels = semantic_labels(blocks)
        if labels:
            labelled.append((blocks, labels))
    return train_field(3 * labelled + laid_out(texts, LAID_OUT))


def extract(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages: the blocks that the field labels main text, in page order, with
    an empty line between. A null or empty page, or one without main text, has the text ''. Repeated rows give repeated
    rows; pages of any length are read whole."""
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            texts = [main_text(p, shared.value) for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    out = rows.mapInPandas(run, "page_id string, url string, text string")
    return out.select(F.col("page_id").cast(kinds[id_col]).alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def main_text(page: str, field: Field) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, main in zip(blocks, field.decode(blocks)) if main)
