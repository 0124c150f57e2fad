"""Pages written by hand, with the main text that they should give: {name: (html, text)}."""

A = "The ferry left the harbour before dawn and nobody on the quay had slept, because the storm of the night before had torn two of the moorings loose"
B = "By noon the wind had dropped. Fishermen mended their nets, and the harbour master counted the boats that were missing."
C = "昨夜の嵐で港の船が二隻流され、漁師たちは夜明け前から岸壁に集まって海を見つめていた"
D = "Three days later the last of them came home under tow, its mast gone and its crew unhurt, to bells and a crowd in the rain"
R = "Паром ушёл до рассвета, и никто на причале не спал, потому что ночью шторм сорвал два каната и унёс лодку старого рыбака"
NAV, FOOT = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>', "<footer><p>© 2024 The Harbour Post. All rights reserved.</p></footer>"


def page(inner: str, before: str = NAV, after: str = FOOT) -> str:
    return f"<html><head><title>The Harbour Post</title><style>p {{ color: red }}</style></head><body>{before}{inner}{after}</body></html>"


def said(*parts: str) -> str:
    return "\n\n".join(parts)


COMMENT = "I was there that night and it was far worse than the paper says, the water came over the wall twice"
OTHER_COMMENT = "My uncle still has a piece of that rope on his kitchen wall, we look at it every Christmas"
ASIDE = "Our reporters have covered the coast for forty years. Read their best pieces in the weekend edition, on sale from Friday."

PAGES = {
    "unstopped paragraph alone": (f"<article><p>{A}</p></article>", A),
    "unstopped paragraph in a page": (page(f"<article><h1>Storm</h1><p>{A}</p></article>"), said("Storm", A)),
    "stopped paragraph alone": (f"<article><p>{B}</p></article>", B),
    "CJK alone": (f"<article><p>{C}</p></article>", C),
    "CJK in a page": (page(f"<article><p>{C}</p><p>{C}</p></article>"), said(C, C)),
    "CJK with a stop": (page(f"<main><p>{C}。</p></main>"), C + "。"),
    "Cyrillic": (page(f"<article><p>{R}</p><p>{R}.</p></article>"), said(R, R + ".")),
    "two unstopped": (page(f"<article><h1>Storm at sea</h1><p>{A}</p><p>{D}</p></article>"), said("Storm at sea", A, D)),
    "main element": (page(f"<main><h1>Storm</h1><p>{A}</p><p>{B}</p></main>"), said("Storm", A, B)),
    "form in the article": (page(f"<article><h1>Storm</h1><p>{A}</p><p>{B}</p><form action=/s><p>Enter your address and we will send you the harbour letter every week.</p><input name=e><button>Send</button></form><p>{D}</p></article>"), said("Storm", A, B, D)),
    "form after the article": (page(f"<article><h1>Storm</h1><p>{A}</p><p>{B}</p></article><form><label>Name</label><p>Tell us what you saw on the night of the storm.</p><button>Send</button></form>"), said("Storm", A, B)),
    "advert in the article": (page(f'<article><h1>Storm</h1><p>{A}</p><div class="ad-slot">Buy new ropes at half the price, only this week at the harbour shop.</div><p>{B}</p></article>'), said("Storm", A, B)),
    "advert with a paragraph": (page(f'<article><h1>Storm</h1><p>{A}</p><div class="ad-slot"><p>Buy new ropes at half the price, only this week at the harbour shop.</p></div><p>{B}</p></article>'), said("Storm", A, B)),
    "aside in the article": (page(f"<article><h1>Storm</h1><p>{A}</p><aside><p>{ASIDE}</p></aside><p>{B}</p></article>"), said("Storm", A, B)),
    "aside with heading": (page(f"<article><h1>Storm</h1><p>{B}</p><aside><h3>Also today</h3><p>{ASIDE}</p></aside><p>{D}</p></article>"), said("Storm", B, D)),
    "sidebar outside": (page(f'<article><h1>Storm</h1><p>{A}</p><p>{B}</p></article><div class="sidebar"><h3>Most read</h3><p>{ASIDE}</p></div>'), said("Storm", A, B)),
    "unnamed comments in divs inside": (page(f"<article><h1>Storm</h1><p>{A}</p><p>{B}</p><div><h3>Comments</h3><div><div>Ann</div><div>2 hours ago</div><div>{COMMENT}</div></div><div><div>bob77</div><div>yesterday</div><div>{OTHER_COMMENT}</div></div></div></article>"), said("Storm", A, B)),
    "unnamed comments outside": (page(f"<article><h1>Storm</h1><p>{A}</p><p>{B}</p></article><section><h2>Comments</h2><div><b>Ann</b> 2 hours ago<p>{COMMENT}</p></div><div><b>bob77</b> yesterday<p>{OTHER_COMMENT}</p></div></section>"), said("Storm", A, B)),
    "named comments": (page(f'<article><h1>Storm</h1><p>{A}</p><p>{B}</p></article><div id="comments"><div class="comment"><p>{COMMENT}</p></div><div class="comment"><p>{OTHER_COMMENT}</p></div></div>'), said("Storm", A, B)),
    "nested comments": (page(f'<article><h1>Storm</h1><p>{A}</p><p>{B}</p></article><ol class="comments"><li><p>Ann, 10:42</p><p>{COMMENT}</p><ol><li><p>bob77, 10:50</p><p>{OTHER_COMMENT}</p></li></ol></li></ol>'), said("Storm", A, B)),
    "cookie notice": (page(f'<div class="cookie-notice"><p>We use cookies to improve your visit.</p></div><article><h1>Storm</h1><p>{A}</p><p>{B}</p></article>'), said("Storm", A, B)),
    "list in the article": (page(f"<article><h1>Storm</h1><p>{A}</p><ul><li>Two boats lost</li><li>Nobody hurt</li></ul><p>{B}</p></article>"), said("Storm", A, "Two boats lost", "Nobody hurt", B)),
    "quote in the article": (page(f"<article><h1>Storm</h1><p>{A}</p><blockquote>{D}</blockquote><p>{B}</p></article>"), said("Storm", A, D, B)),
    "subheadings": (page(f"<article><h1>Storm</h1><p>{A}</p><h2>The day after</h2><p>{B}</p></article>"), said("Storm", A, "The day after", B)),
    "references and white space": (page(f"<article><h1>Storm &amp; calm</h1><p>{A}\n  &ndash; so  they\tsay</p><p>{B}</p></article>"), said("Storm & calm", A + " – so they say", B)),
    "script and style inside": (page(f"<article><h1>Storm</h1><script>var p = '<p>no</p>';</script><p>{A}</p><style>p{{}}</style><p>{B}</p></article>"), said("Storm", A, B)),
    "inline markup": (page(f"<article><h1>Storm</h1><p>{A[:40]}<em>{A[40:60]}</em><a href=/x>{A[60:70]}</a>{A[70:]}</p><p>{B}</p></article>"), said("Storm", A, B)),
    "unclosed paragraphs": (page(f"<article><h1>Storm</h1><p>{A}<p>{B}<p>{D}</article>"), said("Storm", A, B, D)),
    "site header": (page(f"<article><h1>Storm</h1><p>{A}</p><p>{B}</p></article>", f'<header class="masthead"><a href="/">The Harbour Post</a><p>News from the coast since 1911</p></header>{NAV}'), said("Storm", A, B)),
    "div content": (page(f'<div class="content"><h1>Storm</h1><p>{A}</p><p>{B}</p><p>{D}</p></div>'), said("Storm", A, B, D)),
    "share links": (page(f'<article><h1>Storm</h1><p>{A}</p><p>{B}</p><div class="share"><a href=#>Share</a> <a href=#>Tweet</a></div></article>'), said("Storm", A, B)),
    "related links": (page(f'<article><h1>Storm</h1><p>{A}</p><p>{B}</p></article><div class="related"><h3>Related articles</h3><ul><li><a href=/1>Nets mended</a></li><li><a href=/2>Boats counted</a></li></ul></div>'), said("Storm", A, B)),
    "nothing but chrome": (page(""), ""),
    "long article of unstopped lines": (page("<article><h1>Storm</h1>" + "".join(f"<p>{A} {k}</p>" for k in range(12)) + "</article>"), said("Storm", *(f"{A} {k}" for k in range(12)))),
}
