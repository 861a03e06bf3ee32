"""HTML extraction by the maximum-scoring subsequence.

A page is read as one run of words and tags. Every tag costs, every word adds or costs by where it
stands: weights are log odds of a word in each kind of place (a kind is the innermost telling element) being
article text, counted on labelled pages; tags cost by how much more often they stand outside the article.
A linear scan (:func:`best_run`) finds the contiguous run with the largest sum: the content region. Inside it, two rules decide
besides the weights: words in elements that hold no article text (``CLOSED``: nav, footer, aside, form, ...) are left out, and so
are those whose weight the names around them (class, id and role) lower to 0 or less; the others form blocks at block-level tags.
As such words are left out wherever they stand, a stretch of them costs ``BREAK`` at most, so that a long menu between two
parts of an article does not part them.

What a name costs is learnt: its parts ("site-sidebar": site, sidebar) have the log odds with which elements of that name hold article text in
:func:`labelled_layouts`; a name that occurs there whole counts as such. Names on html, body, main and a page's first article
count for nothing, and the headings of an article's own header are text. A form, or an element whose names speak against it, is
read as if it were a plain block if it holds more than half of the page's words outside links and, for names, its first heading, for
a form, any article or main that there is; so are all names on a page that would be left without text.

The labelled pages are small hand-marked ones in :func:`labelled_pages` and layouts in :func:`labelled_layouts`; others can be passed to :func:`fit`.

Defined cases: null, empty and tag-only pages give an empty text; unclosed and crossed tags and truncated
pages are read as far as they go; a page is never cut; repeated rows give equal results; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg math object canvas head title select option textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
TELLING = frozenset("nav header footer aside form menu article main section p h1 h2 h3 h4 h5 h6 li td th blockquote pre figure figcaption div body a dialog details dd dt".split())
#: Elements whose places hold everything below them.
CLOSED = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "header", "lead"])
#: What a stretch of words and tags that are left out in any case costs at most: about a dozen words of prose.
BREAK = 25.0
#: Headings that are text in a header of main or article ("lead"), whose other words neither count nor cost.
TITLES = frozenset(["h1", "h2", "h3"])
#: Elements that hold the article: their names say nothing against it (an article's only if no other came before it).
HOLDERS = frozenset(["html", "body", "main"])
#: Elements that may stand in a head; any other, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
#: Parts of a form around a page that are no text.
OF_FORM = frozenset("fieldset label legend".split())
#: Least letters of a known part that a longer one may begin with ("comments", "commentlist").
STEM = 5

#: Start tags whose end tags may be left out: the open elements that each ends, and the elements it does not look beyond.
_LIST_ENDS = frozenset("article aside blockquote body button center details dialog dir dl fieldset figcaption figure footer form header main menu nav ol section summary table td th ul".split())
_ROW_GROUPS = frozenset("thead tbody tfoot".split())
_CELLS = frozenset(("td", "th"))
IMPLIED = {
    "li": (frozenset(("li",)), _LIST_ENDS),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), _LIST_ENDS)),
    **dict.fromkeys(_CELLS, (_CELLS, frozenset(("tr", "table")))),
    "tr": (_CELLS | {"tr"}, _ROW_GROUPS | {"table"}),
    **dict.fromkeys(_ROW_GROUPS, (_CELLS | _ROW_GROUPS | {"tr"}, frozenset(("table",)))),
}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|$)|([^<]+|<)", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: A slash at the end that is not part of a value without quotes.
SELF_CLOSED = re.compile(r"(?:^|[\s\"']|(?:^|\s)[^\s=]+)/$")
CLOSERS = {s: re.compile(rf"</{s}\b[^>]*>", re.I) for s in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}


def _names(attributes: str) -> list[str]:
    """Names in class, id and role, as they stand."""
    return [w for m in NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split()] if "=" in attributes else []


def _parts(name: str) -> list[str]:
    """ "siteSidebar", "site_sidebar", "site-sidebar-2": site, sidebar."""
    return [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]


class Names:
    """Log odds of names of elements and of their parts."""

    def __init__(self, whole: dict[str, float], parts: dict[str, float]):
        self.whole, self.parts = whole, parts
        self.stems = sorted((p for p, w in parts.items() if len(p) >= STEM and w < 0), key=len, reverse=True)

    def part(self, p: str) -> float:
        if p in self.parts:
            return self.parts[p]
        stem = next((x for x in self.stems if p.startswith(x)), None)
        return self.parts[stem] if stem else 0.0

    def score(self, attributes: str) -> float:
        """What the names of an element add to the weight of the words below it."""
        total = 0.0
        for name in _names(attributes):
            own = self.whole.get(name.lower())
            total += own if own is not None else sum(map(self.part, _parts(name)))
        return max(-4.0, min(0.5, total))


NO_NAMES = Names({}, {})


class _Held:
    """Words outside links, in all and in each element that its names or a form close, and which of those hold the first heading."""

    def __init__(self):
        self.words, self.inside, self.titled, self.forms, self.title = 0, Counter(), set(), set(), False
        self.article = False  # one stands outside all of them

    def plain(self) -> frozenset[int]:
        """Elements to read as plain blocks."""
        return frozenset(k for k, n in self.inside.items() if 2 * n > self.words and (not self.article if k in self.forms else k in self.titled))


def events(page: str, names: Names = NO_NAMES, plain: frozenset[int] = frozenset(), held: _Held | None = None):
    """Yields ("tag", name, block?, place) and ("text", decoded text, place) in page order; place: the kind that counts, "" for none, then "~" and what names cost, if anything.

    ``plain``: start tags, by number, that are read as plain blocks; ``held`` is filled on the way.
    """
    stack: list[tuple[str, str, int | None]] = []  # element, place inside it, the start tag that closes it
    number, articles = 0, 0
    opened: Counter[str] = Counter()  # elements of the stack by name, so that an end tag without a start costs nothing

    def cut(k: int) -> None:
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.match(page, pos)
        pos = m.end()
        name = m[2].lower() if m[2] else ""
        if opened["head"] and (m[4].strip() if m[4] is not None else name and not m[1] and name not in IN_HEAD):
            cut(next(k for k, x in enumerate(stack) if x[0] == "head"))
        place, closer = stack[-1][1:] if stack else ("", None)
        if m[4] is not None:
            text = html.unescape(m[4])
            if held is not None and place != "silent" and not opened["a"]:
                held.words += (n := len(text.split()))
                if closer is not None:
                    held.inside[closer] += n
            yield "text", text, place
        elif m[2]:
            if m[1]:
                if opened[name]:
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    cut(k)
                yield "tag", "/" + name, name not in INLINE, stack[-1][1] if stack else ""
                continue
            number += 1
            if held is not None and name == "h1" and not held.title:
                held.title = True
                held.titled |= {x[2] for x in stack if x[2] is not None}
            yield "tag", name, name not in INLINE, place
            if name in CLOSERS:
                c = CLOSERS[name].search(page, pos)
                pos = c.end() if c else end
            elif name not in VOID and not SELF_CLOSED.search(m[3]):
                if name in ("p", "option") and stack and stack[-1][0] == name:
                    cut(len(stack) - 1)
                elif name in IMPLIED:
                    ends, beyond = IMPLIED[name]
                    if any(opened[e] for e in ends):
                        k, at = len(stack) - 1, None
                        while k >= 0 and stack[k][0] not in beyond:
                            if stack[k][0] in ends:
                                at = k
                            k -= 1
                        if at is not None:
                            cut(at)
                place, closer = stack[-1][1:] if stack else ("", None)
                base, _, named = place.partition("~")
                articles += name == "article"
                if held is not None and closer is None and name in ("article", "main"):
                    held.article = True
                if name in SILENT:
                    kind = "silent"
                elif base == "lead" and name in TITLES:
                    kind = name
                elif name == "header" and base not in CLOSED and (opened["article"] or opened["main"]):
                    kind = "lead"
                elif base == "silent" or base.removesuffix("+a") in CLOSED:
                    kind = place
                else:
                    kind = name if name in TELLING and number not in plain else base
                    if kind == "a" and base:
                        kind = base.removesuffix("+a") + "+a"
                    if name in OF_FORM and opened["form"]:
                        kind = "form"
                    cost = float(named or 0)
                    if number not in plain and name not in HOLDERS and (name != "article" or articles > 1):
                        cost = min(0.0, cost + names.score(m[3]))
                    if cost:
                        kind += f"~{cost:.2f}"
                    if closer is None and (name == "form" or cost) and number not in plain:
                        closer = number
                        if held is not None and name == "form":
                            held.forms.add(number)
                stack.append((name, kind, closer))
                opened[name] += 1


class Weights:
    """Log odds for words by place, costs of tags, and names."""

    def __init__(self, words: dict[str, float], tags: dict[str, float], names: Names = NO_NAMES):
        self.words, self.tags, self.names = words, tags, names

    def word(self, place: str) -> float:
        if place in ("silent", "lead"):
            return 0.0
        place, _, named = place.partition("~")
        return self._of(place) + float(named or 0)

    def _of(self, place: str) -> float:
        if place in self.words:
            return self.words[place]
        base = place.removesuffix("+a")
        return self.words.get(base, -2.0 if base in CLOSED else 0.5) - (0.7 if base != place else 0.0)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.5)


def learnt_names(pages: list[list[tuple[str, bool]]]) -> Names:
    """Names by the share of article text in the elements that bear them, in pages of (piece of HTML, whether it is article text)."""
    seen: dict[str, Counter] = {"yes": Counter(), "no": Counter()}
    for pieces in pages:
        stack: list[list] = []  # element, names, words that are article text, others
        for piece, label in pieces:
            for m in TOKEN.finditer(piece):
                if m[4] is not None:
                    for entry in stack:
                        entry[2 if label else 3] += len(m[4].split())
                elif m[2] and not m[1]:
                    if m[2].lower() not in VOID:
                        stack.append([m[2].lower(), _names(m[3]) if m[2].lower() not in HOLDERS else [], 0, 0])
                elif m[2] and stack:
                    _, own, yes, no = stack.pop()
                    if yes + no:
                        for name in own:
                            for key in {f"={name.lower()}", *_parts(name)}:
                                seen["yes"][key] += yes / (yes + no)
                                seen["no"][key] += no / (yes + no)
    odds = {k: max(-3.0, min(3.0, math.log((seen["yes"][k] + 0.1) / (seen["no"][k] + 0.1)))) for k in {*seen["yes"], *seen["no"]}}
    return Names({k[1:]: w for k, w in odds.items() if k[0] == "="}, {k: w for k, w in odds.items() if k[0] != "="})


def fit(pages: list[list[tuple[str, bool]]], layouts: list[list[tuple[str, bool]]] | None = None) -> Weights:
    """Weights from labelled pages, each a list of (piece of HTML, whether it is article text); names from those and from ``layouts``."""
    names = learnt_names([*pages, *(labelled_layouts() if layouts is None else layouts)])
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for pieces in pages:
        whole, marks, at = "".join(p for p, _ in pieces), [], 0
        for p, label in pieces:
            at += len(p)
            marks.append((at, label))
        seen = 0
        for kind, what, *rest in _positioned(whole, names):
            at = rest[-1]
            while marks[seen][0] <= at and seen < len(marks) - 1:
                seen += 1
            label = marks[seen][1]
            if kind == "text":
                if rest[0] != "silent":
                    base, _, named = rest[0].partition("~")
                    words[label]["~" if named else base] += len(what.split())
            else:
                tags[label][what] += 1
    odds = lambda c, k, s: math.log((c[True][k] + s) / (sum(c[True].values()) + 1)) - math.log((c[False][k] + s) / (sum(c[False].values()) + 1))
    clip = lambda x: max(-3.0, min(3.0, x))
    return Weights({k: clip(odds(words, k, 0.5)) for k in {*words[True], *words[False]}}, {k: -0.2 + min(0.0, clip(odds(tags, k, 0.5))) / 3 for k in {*tags[True], *tags[False]}}, names)


def _positioned(page: str, names: Names):
    """events() with the place in the page of each: pieces of labelled pages end at tags, so counting is enough."""
    at = 0
    for e in events(page, names):
        if e[0] == "text":
            yield "text", e[1], e[2], at
            at = page.find("<", at + 1)
        else:
            found = re.compile(rf"<{re.escape(e[1])}\b", re.I).search(page, max(at, 0))
            at = found.start() if found else at
            yield "tag", e[1], e[3], at
            at = page.find(">", at) + 1


def extract(page: str | None, weights: Weights) -> str:
    """The main text of ``page``. Where names would leave no word of it, it is read without them."""
    held = _Held()
    found = list(events(page or "", weights.names, held=held))
    plain: frozenset[int] = frozenset()
    while more := held.plain() - plain:  # what such an element holds may be such an element itself
        plain, held = plain | more, _Held()
        found = list(events(page or "", weights.names, plain, held))
    text = _extract(found, weights)
    if not text and any("~" in e[-1] for e in found):
        text = _extract([(*e[:-1], e[-1].partition("~")[0]) for e in found], weights)
    return text


def best_run(scores: list[float]) -> tuple[int, int] | None:
    """First and last place of the contiguous run with the largest sum (of equal ones the first that ends); None if no sum is above 0. One pass."""
    best, span, total, start = 0.0, None, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i)
    return span


def _extract(found: list[tuple], weights: Weights) -> str:
    blocks: list[list] = []  # (text pieces), one for each run between block tags
    items: list[tuple[float, int]] = []  # score, block or -1 for a tag
    open_block, left = False, BREAK  # what a stretch that is left out may still cost

    def kept(place: str) -> bool:
        return place.partition("~")[0].removesuffix("+a") not in CLOSED and ("~" not in place or weights.word(place) > 0)

    for kind, what, *rest in found:
        if kind == "tag":
            score = weights.tag(what) if rest[-1] != "lead" else 0.0
            if not kept(rest[-1]):
                score = max(score, -left)
                left += min(score, 0.0)
            items.append((score, -1))
            if rest[0]:
                open_block = False
            elif what == "br" and open_block:
                blocks[-1].append((" ", ""))
            continue
        place = rest[0]
        if place == "silent":
            continue
        n = len(what.split())
        if not open_block:
            blocks.append([])
            open_block = True
        blocks[-1].append((what, place))
        if n:
            score = n * weights.word(place)
            if kept(place):
                left = BREAK
            else:
                score = max(score, -left)
                left += min(score, 0.0)
            items.append((score, len(blocks) - 1))
    span = best_run([score for score, _ in items])
    if span is None:
        return ""
    inside = {b for _, b in items[span[0] : span[1] + 1] if b >= 0}
    out = []
    for b in sorted(inside):
        text = " ".join("".join(t for t, place in blocks[b] if kept(place)).split())
        if text:
            out.append(text)
    return "\n".join(out)


def labelled_pages() -> list[list[tuple[str, bool]]]:
    """Small pages marked by hand: article text True, everything else False."""
    prose = "<p>The river rose in the night and the lower fields were under water by dawn.</p><p>Nobody was hurt, said the keeper of the lock, but <a href='/b'>two barges</a> broke loose and came to rest below the old bridge.</p>"
    more = "<h2>What comes next</h2><p>Engineers will look at the dam on Monday.<br>Until then the road stays shut, and traffic goes by the <b>northern</b> pass.</p><ul><li>Bring water and warm clothing</li><li>Leave pets with neighbours</li></ul><blockquote>We have seen worse than this in my time here.</blockquote>"
    nav = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul></nav>"
    return [
        [("<html><head><title>Flood</title></head><body>" + nav + "<div class='ad'>Buy one now and save.</div>", False), ("<article><h1>River floods fields</h1>" + prose + more, True), ("</article><footer>Copyright The Paper. All rights reserved.</footer></body></html>", False)],
        [("<html><body><header><a href='/'>The Paper</a><form><input name='q'>Search the site</form></header>", False), ("<main><h1>River floods fields</h1>" + prose, True), ("</main><aside><h3>Most read</h3><ul><li><a href='/1'>Ten tips for rain</a></li><li><a href='/2'>Dams of the north</a></li></ul></aside><div class='comments'><p>Great piece, thanks!</p><p>I saw it too from my house.</p></div><footer><a href='/t'>Terms</a> <a href='/p'>Privacy</a></footer></body></html>", False)],
        [("<html><body><div id='menu'><a href='/'>Start</a><a href='/a'>Archive</a></div><div class='cookie-notice'>We use cookies to improve your visit.</div><div id='body'><div>", False), ("<p>Short news from the valley today, with more to come later in the week.</p>" + prose, True), ("</div></div><div class='sidebar'><div>Weather: rain, later dry</div><div><a href='/w'>Full forecast</a></div></div><div class='share'><a href='#'>Share this</a></div></body></html>", False)],
        [("<html><body><div id='top'><p><a href='/'>Kitchen Notes</a></p><ul><li><a href='/r'>Recipes</a></li><li><a href='/t'>Tools</a></li></ul></div>", False), ("<article><header><h1>Bread without kneading</h1></header><p>Mix flour, water and salt in a bowl and leave it under a cloth until the next day.</p><ol><li>Heat the pot for half an hour.</li><li>Turn the dough into it and bake with the lid on.</li></ol><p>It keeps for three days if you wrap it in linen, and toasts well after that.</p></article>", True), ("<div class='related'><h3>You may also like</h3><p><a href='/1'>Soda bread</a> <a href='/2'>Rye in a tin</a></p></div><div class='newsletter'><p>One letter a month, no more. Leave your address below.</p></div><footer><p>All recipes tested twice.</p></footer></body></html>", False)],
        [("<html><body><div class='navbar'><span><a href='/'>Docs</a></span><span><a href='/api'>Reference</a></span></div>", False), ("<main><h1>Installing the client</h1><p>The client needs a recent runtime and about ten megabytes of disk.</p><pre>install client\nclient init</pre><dl><dt>port</dt><dd>Where the service listens; any free one will do.</dd><dt>log</dt><dd>A file that the client may write to.</dd></dl><figure><img src='a.png'><figcaption>The first screen after a fresh start</figcaption></figure></main>", True), ("<nav><a href='/p'>Previous</a><a href='/n'>Next</a></nav><div id='cookie-banner'><p>This site keeps a cookie to remember your theme.</p></div><footer><ul><li><a href='/l'>License</a></li><li><a href='/c'>Contact</a></li></ul></footer></body></html>", False)],
        [("<html><body><header><h2>City Forum</h2><p>Talk of the town since long ago</p></header><div class='breadcrumb'><a href='/'>Home</a> <a href='/f'>Transport</a></div>", False), ("<div class='post'><h2>Night buses to the harbour</h2><p>From next month two lines will run to the harbour after midnight, the council said on Tuesday.</p><p>Tickets cost the same as by day. Whoever has a pass rides for free, and dogs do too.</p></div>", True), ("<div class='ads'><p>Bikes from ninety nine, only this week!</p></div><section class='replies'><h3>Two replies</h3><p>About time, thank you.</p><p>And what of the hill?</p></section><aside><p>Members online: twelve</p></aside><footer>Rules and privacy</footer></body></html>", False)],
        [("<html><body><table><tr><td><a href='/'>Index</a></td><td><a href='/x'>Contact</a></td></tr></table>", False), ("<section><h1>Notes</h1>" + prose + more + "<table><tr><td>Gauge at noon</td><td>three metres</td></tr></table></section>", True), ("<div class='promo'><p>Sign up for our letter and never miss a story.</p></div><form><label>Your name</label></form><footer><p>Made by hand since the year one.</p></footer></body></html>", False)],
    ]


#: Names of common page layouts: around the article, and of what stands around it, one layout a line.
LAYOUTS = """
site-main content-area post hentry entry-content entry-title | site-header site-branding main-navigation menu-toggle primary-menu widget-area sidebar secondary widget comments-area comment-list comment-body comment-respond reply entry-footer entry-meta post-navigation site-footer site-info
page-content article-body article-content story story-body | masthead top-bar topbar nav-links navbar breadcrumb breadcrumbs related-articles related recommended recommendations trending most-read most-popular popular more-stories newsletter newsletter-signup subscribe subscription signup share share-buttons social social-links follow colophon copyright legal
main-content content text body-text lead prose | skip-link skip header logo menu main-menu submenu off-canvas search-form searchbox search login login-form cookie-notice cookie-banner cookie-bar cookie-consent consent consent-banner gdpr gdpr-banner footer footer-links back-to-top
field-name-body node node-content region-content | region-header region-navigation block-menu block-search region-sidebar-first sidebar-first sidebar-second pager pagination tabs block-comments comment comment-wrapper links region-footer
mw-body-content parser-output bodycontent page-body | mw-navigation mw-panel toc toc-list catlinks sitenotice notice printfooter jump-to-nav personal portlet
post-content post-body post-text post-full-content | ad ads advert adverts advertisement ad-slot ad-banner adsense sponsor sponsored promo promotion promoted banner post-meta author-box author-bio byline tags tag-list tagcloud related-posts related-stories disqus disqus-thread discussion responses replies reply-list
document documentation section-text markdown-body | sphinxsidebar side-nav side sidebar-wrapper sidebar-right sidebar-left nav nav-bar navigation toolbar header-links footer-wrapper footer-nav social-icons sharing share-bar
layout-content with-sidebar has-sidebar content-wrapper page-wrapper | aside-content overlay modal popup popup-banner alert alert-bar paywall teaser teaser-list outbrain taboola user-comments comment-thread comments comments-section comment-form comment-count
article article-text article-main main | contentinfo complementary navigation banner search dialog alert form cookies cookie-message privacy-banner privacy-notice site-notice site-navigation site-menu mobile-menu dropdown-menu mega-menu
"""


def labelled_layouts() -> list[list[tuple[str, bool]]]:
    """A page for each layout and way of naming (class or id): its article in each of the article's names, and a block for each other name."""
    said = ("The lock on the canal was mended in spring, and boats of any length may pass again.", "Bake the loaf until it sounds hollow, then let it cool on a rack.", "The council heard both sides and put off the vote until the autumn.")
    out = []
    for i, line in enumerate(LAYOUTS.strip().split("\n")):
        own, others = (x.split() for x in line.split("|"))
        for attribute in ("class", "id"):
            page = [(f"<div {attribute}='{name}'><p>{said[(i + k) % 3]}</p></div>", True) for k, name in enumerate(own)]
            out.append(page + [(f"<div {attribute}='{name}'><p>Elsewhere on this site</p></div>", False) for name in others])
    return out


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    weights = weights or fit(labelled_pages())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [extract(h, weights) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
