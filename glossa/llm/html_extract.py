"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the tree.

A page is parsed into its block elements.  Each gets features of its subtree (text, density, link share, sentence marks),
its place (depth, siblings), its tag, and the tokens of its class, id and role, its own and its ancestors'.  Two boosted
ensembles of symmetric trees give the chance that an element is boilerplate, and that one that is not is content rather
than a container of both.  Decoding picks the likeliest labelling in which nothing below boilerplate is kept and only
content or boilerplate stands below content.

The trees are trained here, once per session, on labelled pages that `sample_page` makes up from layout rules.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

# HTML's element classes, as the standard names them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes select button datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of the value, unless one of SCOPE stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"datalist"}}
NOT_TEXT = frozenset("head".split())

# Groups of tokens of class, id and role.
GROUPS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager toc tabs sitemap topnav skip",
    "header": "header masthead topbar branding logo site-header page-header hero top",
    "footer": "footer foot bottom copyright legal colophon site-footer contentinfo",
    "side": "sidebar side aside rail widget widgets complementary secondary column-right right-col left-col",
    "comment": "comment comments commentlist respond reply replies disqus discussion thread reviews feedback guestbook",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner-ad dfp adslot adbox commercial",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner message disclaimer paywall privacy announcement warning toast",
    "form": "form login signin signup register subscribe newsletter search searchbox contact-form optin mailing",
    "social": "share sharing social related recommended more-stories read-next tags tag-list author-bio byline meta follow trending popular",
    "content": "article content main post entry story body text article-body post-content entry-content page-content maincontent prose copy column-main primary",
}
TOKEN_GROUP = {t: k for k, words in enumerate(GROUPS.values()) for w in words.split() for t in (w, *w.split("-")) if t not in ("page", "site", "list", "right", "left", "more", "read", "next", "bio", "col", "column", "contact", "stories")}
TAG_GROUP = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "form": 7, "fieldset": 7, "dialog": 6, "search": 7, "article": 9, "main": 9}
N_GROUPS = len(GROUPS)
TAG_KINDS = [{"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu"}, {"table", "tbody", "thead", "tr", "td", "th", "tfoot"}, {"div", "section", "center"}, {"body", "html"}, {"article"}, {"main"}, {"figure", "figcaption"}, {"pre", "blockquote"}]
N_FEATURES = 13 + len(TAG_KINDS) + 2 * N_GROUPS

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9-]+|(?<=[a-z])(?=[A-Z])")
LABEL = re.compile(r'data-y="(\w)"')


@functools.lru_cache(4096)
def attribute_groups(attributes: str) -> int:
    """Bit set of the groups that class, id and role name."""
    found = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        for token in re.split(r"[^a-z0-9-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a or b or c).lower()):
            for t in (token, *re.split(r"[-_0-9]+", token)):
                if t in TOKEN_GROUP:
                    found |= 1 << TOKEN_GROUP[t]
    return found


class Page:
    """Block elements in document order, and text blocks."""

    __slots__ = ("tag", "parent", "groups", "label", "blocks", "owner", "links")

    def __init__(self, source: str):
        self.tag, self.parent, self.groups, self.label = ["html"], [-1], [0], ["M"]
        self.blocks: list[str] = []  # text of each block
        self.owner: list[int] = []  # its innermost block element
        self.links: list[int] = []  # characters of it inside links
        stack, current, linked, in_link, upto = [0], [], 0, 0, 0
        skip = None
        find = TOKEN.search
        match = find(source)

        def flush():
            nonlocal current, linked
            text = " ".join("".join(current).split())
            if text:
                self.blocks.append(text)
                self.owner.append(stack[-1])
                self.links.append(min(linked, len(text)))
            current, linked = [], 0

        while match:
            start = match.start()
            if start > upto:
                text = source[upto:start]
                if "&" in text:
                    text = html.unescape(text)
                current.append(text)
                if in_link:
                    linked += len(text.strip())
            upto = match.end()
            name = match[2] or match[5]
            if name:
                name = name.lower()
                closing = match[1] or match[4]
                if name in RAW:
                    if not closing and not (match[3] or match[6] or "").rstrip().endswith("/"):
                        end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, upto)
                        upto = end.end() if end else (len(source) if name in ("script", "style", "textarea", "title") else upto)
                elif name in BLOCK:
                    flush()
                    if closing:
                        if name in [self.tag[k] for k in stack[1:]]:
                            while self.tag[stack.pop()] != name:
                                pass
                    elif name != "html":
                        if "p" in (top := self.tag[stack[-1]]) and top == "p":
                            stack.pop()
                        if name in CLOSES:
                            for k in range(len(stack) - 1, 0, -1):
                                tag = self.tag[stack[k]]
                                if tag in SCOPE[name]:
                                    break
                                if tag in CLOSES[name]:
                                    del stack[k:]
                                    if name not in ("td", "th", "tr", "tbody", "tfoot"):
                                        break
                        attributes = match[3] or match[6] or ""
                        self.tag.append(name)
                        self.parent.append(stack[-1])
                        self.groups.append(attribute_groups(attributes) if "=" in attributes else 0)
                        marked = LABEL.search(attributes) if "data-y" in attributes else None
                        self.label.append(marked[1] if marked else "")
                        stack.append(len(self.tag) - 1)
                    in_link = 0 if name not in ("div", "li", "p") else in_link
                elif name == "a":
                    in_link = 0 if closing else 1
                elif name in ("br", "hr", "img"):
                    current.append(" ")
            match = find(source, upto)
        if upto < len(source):
            text = source[upto:]
            current.append(html.unescape(text) if "&" in text else text)
        flush()


def features(page: Page) -> np.ndarray:
    """float32 [elements, N_FEATURES]."""
    n = len(page.tag)
    chars, linked, words, marks, blocks, inner = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for text, k, a in zip(page.blocks, page.owner, page.links):
        chars[k] += len(text)
        linked[k] += a
        words[k] += text.count(" ") + 1
        marks[k] += text.count(". ") + text.count(",") + text.endswith((".", "!", "?"))
        blocks[k] += 1
    children, order, depth, above = [0] * n, [0] * n, [0] * n, [0] * n
    own = [g | (1 << TAG_GROUP[t] if t in TAG_GROUP else 0) for g, t in zip(page.groups, page.tag)]
    for k in range(1, n):
        p = page.parent[k]
        order[k] = children[p]
        children[p] += 1
        depth[k] = depth[p] + 1
        above[k] = above[p] | own[p]
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        words[p] += words[k]
        marks[p] += marks[k]
        blocks[p] += blocks[k]
        inner[p] += inner[k] + 1
    x = np.zeros((n, N_FEATURES), np.float32)
    parent = np.array(page.parent)
    parent[0] = 0
    c, w, b = (np.array(v, np.float32) for v in (chars, words, blocks))
    siblings = np.array(children, np.float32)[parent]
    one = np.float32(1)
    x[:, 0] = np.log1p(c)
    x[:, 1] = np.array(linked, np.float32) / np.maximum(c, one)
    x[:, 2] = c / max(c[0], one)
    x[:, 3] = np.log1p(np.array(inner, np.float32))
    x[:, 4] = np.log1p(c / (np.array(inner, np.float32) + one))
    x[:, 5] = depth
    x[:, 6] = np.array(order, np.float32) / np.maximum(siblings, one)
    x[:, 7] = np.log1p(siblings)
    x[:, 8] = c / np.maximum(c[parent], one)
    x[:, 9] = np.array(marks, np.float32) / np.maximum(w, one)
    x[:, 10] = w / np.maximum(b, one)
    x[:, 11] = c[0] and np.log1p(c[0])
    x[:, 12] = x[parent, 1]
    kinds = [KIND.get(t, -1) for t in page.tag]
    for k, kind in enumerate(kinds):
        if kind >= 0:
            x[k, 13 + kind] = 1
    at = 13 + len(TAG_KINDS)
    bits = np.array([own, above], np.int64)
    for g in range(N_GROUPS):
        x[:, at + g] = bits[0] >> g & 1
        x[:, at + N_GROUPS + g] = bits[1] >> g & 1
    return x


KIND = {t: k for k, tags in enumerate(TAG_KINDS) for t in tags}


# ---------------------------------------------------------------------------------------------- boosted trees

def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, penalty: float = 2.0):
    """Symmetric trees for log odds: (features [rounds, depth], thresholds [rounds, depth], leaves [rounds, 2**depth], start)."""
    n, d = x.shape
    edges = np.stack([np.quantile(x, q, axis=0) for q in np.linspace(0.02, 0.98, bins - 1)])
    code = np.stack([np.searchsorted(np.unique(edges[:, k]), x[:, k], side="left") for k in range(d)], 1)
    edges = [np.unique(edges[:, k]) for k in range(d)]
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    f = np.full(n, start)
    which, above, leaves = np.zeros((rounds, depth), np.int64), np.zeros((rounds, depth)), np.zeros((rounds, 1 << depth))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p) + 1e-6
        leaf = np.zeros(n, np.int64)
        for level in range(depth):
            best = (-1.0, 0, 0)
            for k in range(d):
                if len(edges[k]) < 1:
                    continue
                m = len(edges[k]) + 1
                at = leaf * m + code[:, k]
                left_g = np.bincount(at, g, minlength=m << level).reshape(-1, m).cumsum(1)
                left_h = np.bincount(at, h, minlength=m << level).reshape(-1, m).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = (left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty)).sum(0)[:-1]
                if (top := int(gain.argmax())) is not None and gain[top] > best[0] + 1e-9:
                    best = (float(gain[top]), k, top)
            _, k, top = best
            which[r, level], above[r, level] = k, edges[k][top]
            leaf = leaf * 2 + (code[:, k] > top)
        leaves[r] = rate * np.bincount(leaf, g, minlength=1 << depth) / (np.bincount(leaf, h, minlength=1 << depth) + penalty)
        f += leaves[r][leaf]
    return which, above.astype(np.float32), leaves.astype(np.float32), np.float32(start)


def log_odds(model, x: np.ndarray) -> np.ndarray:
    which, above, leaves, start = model
    columns = np.ascontiguousarray(x.T)
    out = np.full(len(x), start, np.float32)
    for k, t, v in zip(which, above, leaves):
        leaf = np.zeros(len(x), np.intp)
        for a, b in zip(k, t):
            leaf = leaf * 2 + (columns[a] > b)
        out += v[leaf]
    return out


def decode(parent: list[int], used: list[bool], drop: np.ndarray, content: np.ndarray) -> list[int]:
    """The likeliest consistent labels: 0 container, 1 content, 2 boilerplate.

    drop and content: log odds of boilerplate, and of content given that it isn't.  Below boilerplate all is
    boilerplate; below content there is content or boilerplate.
    """
    n = len(parent)
    soft = lambda v: -np.logaddexp(0, -v)
    kept = soft(-drop)
    m, c, b = (kept + soft(-content)).tolist(), (kept + soft(content)).tolist(), soft(drop).tolist()
    for k in range(n - 1, 0, -1):
        if used[k]:
            p = parent[k]
            cb = c[k] if c[k] > b[k] else b[k]
            m[p] += m[k] if m[k] > cb else cb
            c[p] += cb
            b[p] += b[k]
    label = [0] * n
    label[0] = max((m[0], 0), (c[0], 1))[1]
    for k in range(1, n):
        up = label[parent[k]]
        if up == 2:
            label[k] = 2
        elif up == 1:
            label[k] = 1 if c[k] > b[k] else 2
        else:
            label[k] = 0 if m[k] > c[k] and m[k] > b[k] else 1 if c[k] > b[k] else 2
    return label


# ---------------------------------------------------------------------------------------------- training pages

def sample_page(rng: random.Random) -> str:
    """A made-up page whose elements carry their label in data-y: C content, B boilerplate, M a container of both."""
    syllables = "ba ce di fo gu ha ke li mo nu pa re si to vu wa ze shi tra ple".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(lo=3, hi=22):
        w = [word() for _ in range(rng.randint(lo, hi))]
        if len(w) > 6 and rng.random() < 0.6:
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + rng.choice("....!?")

    prose = lambda lo=1, hi=6: " ".join(sentence() for _ in range(rng.randint(lo, hi)))
    short = lambda: " ".join(word() for _ in range(rng.randint(1, 4)))
    link = lambda: f'<a href="/{word()}">{short()}</a>'
    named = rng.random()

    def at(group=None, extra=0.0):
        """Attributes: names are left out on some pages."""
        if group is None or named < 0.2 or rng.random() < extra:
            return rng.choice(["", "", f' class="{word()}"', f' id="{word()}{rng.randint(1, 99)}"'])
        token = rng.choice(GROUPS[group].split())
        token = rng.choice([token, token, f"{word()}-{token}", f"{token}-{rng.randint(1, 9)}", f"{token} {word()}"])
        return f' {rng.choice(["class", "class", "id"])}="{token}"'

    el = lambda tag, y, body, a="": f'<{tag}{a} data-y="{y}">{body}</{tag}>'
    links = lambda y, k=None: el("ul", y, "".join(el("li", y, link()) for _ in range(k or rng.randint(2, 9))))
    semantic = rng.random() < 0.6

    def tag(name):
        return name if semantic and rng.random() < 0.9 else "div"

    def nav():
        return el(tag("nav"), "B", links("B") if rng.random() < 0.7 else " | ".join(link() for _ in range(rng.randint(3, 8))), at("nav"))

    def header():
        inner = [el(rng.choice(["div", "p", "h1", "h2"]), "B", short()), el("p", "B", sentence(2, 7)) if rng.random() < 0.5 else "", nav() if rng.random() < 0.5 else ""]
        return el(tag("header"), "B", "".join(inner), at("header"))

    def footer():
        inner = ["&copy; " + short() + " &middot; " + sentence(2, 10)]
        if rng.random() < 0.6:
            inner = [el("p", "B", x) for x in inner] + [links("B", 3) if rng.random() < 0.6 else "", el("p", "B", prose(1, 3)) if rng.random() < 0.4 else ""]
        return el(tag("footer"), "B", "".join(inner), at("footer"))

    def boxed(group, outer="div"):
        kind = rng.random()
        body = sentence(2, 14) if kind < 0.3 else "".join(el("p", "B", prose(1, 4)) for _ in range(rng.randint(1, 3))) if kind < 0.65 else el("h3", "B", short()) + links("B")
        return el(outer, "B", body, at(group) if named >= 0.2 or outer != "div" else f' class="{rng.choice(GROUPS[group].split())}"')

    def form():
        return el("form", "B", el("p", "B", sentence(2, 9)) + el("div", "B", f"<label>{short()}</label> <input name='q'>") + f"<button>{word()}</button>", at("form"))

    def comments():
        shape, out = rng.choice(["article", "li", "div"]), []
        for _ in range(rng.randint(1, 12)):
            inner = el("p", "B", prose(1, 4)) if rng.random() < 0.7 else sentence()
            out.append(el(shape, "B", (el("div", "B", short()) if rng.random() < 0.6 else "") + inner, at("comment", 0.3) if shape != "li" else ""))
        body = "".join(out)
        body = el("ol", "B", body) if shape == "li" else body
        return el(rng.choice(["section", "div", "div", "aside"]), "B", (el("h2", "B", short()) if rng.random() < 0.7 else "") + body + (form() if rng.random() < 0.3 else ""), f' {rng.choice(["id", "class"])}="{rng.choice(GROUPS["comment"].split())}"')

    def inline(text):
        if rng.random() < 0.3:
            w = text.split(" ")
            k = rng.randrange(len(w))
            w[k] = rng.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "{}<br>"]).format(w[k])
            return " ".join(w)
        return text

    def body_part():
        kind = rng.random()
        if kind < 0.68:
            return el("p", "C", inline(prose(1, rng.choice([1, 3, 8])) if rng.random() < 0.8 else sentence(1, 4)))
        if kind < 0.78:
            return el(rng.choice(["h2", "h3"]), "C", short())
        if kind < 0.86:
            return el(rng.choice(["ul", "ol"]), "C", "".join(el("li", "C", inline(sentence(2, 12))) for _ in range(rng.randint(2, 6))))
        if kind < 0.91:
            return el("blockquote", "C", el("p", "C", prose(1, 3)) if rng.random() < 0.5 else prose(1, 2))
        if kind < 0.94:
            return el("pre", "C", sentence(5, 20))
        if kind < 0.97:
            return el("table", "C", "".join(el("tr", "C", "".join(el("td", "C", short()) for _ in range(3))) for _ in range(rng.randint(1, 4))))
        return el("figure", "C", "<img src='x.png'>" + el("figcaption", "C", sentence(3, 9)))

    def article():
        heading = el("h1", "C", short() if rng.random() < 0.5 else sentence(3, 9)) if rng.random() < 0.85 else ""
        if heading and semantic and rng.random() < 0.15:
            heading = el("header", "C", heading)
        parts = [body_part() for _ in range(rng.choice([1, 1, 2, 4, 8, 15, 30]))]
        if rng.random() < 0.15:
            heading, parts = el("h1", "C", title := sentence(1, 5)), [el("p", "C", title), *parts[1:]]
        if rng.random() < 0.2:
            parts = [el("div", "C", "".join(parts), at("content", 0.4))]
        elif rng.random() < 0.2:
            cut = len(parts) // 2
            parts = [el("section", "C", "".join(parts[:cut])), el("section", "C", "".join(parts[cut:]))]
        for group in ("ad", "social", "notice", "form", "comment"):
            if rng.random() < 0.18:
                extra = form() if group == "form" else comments() if group == "comment" else boxed(group, rng.choice(["div", "div", "aside", "section"]))
                parts.insert(len(parts) if group == "comment" else rng.randint(0, len(parts)), extra)
        outer = "article" if semantic and rng.random() < 0.85 else rng.choice(["div", "section", "div"])
        return el(outer, "C", heading + "".join(parts), at("content", 0.5) if outer == "article" or named >= 0.2 else "")

    main = article()
    if rng.random() < 0.5:
        extra = [boxed(rng.choice(["ad", "social", "notice"])) if rng.random() < 0.3 else "", comments() if rng.random() < 0.35 else ""]
        main = el(tag("main"), "M", (nav() if rng.random() < 0.2 else "") + main + "".join(extra), at("content", 0.3))
    before = [header() if rng.random() < 0.6 else "", nav() if rng.random() < 0.6 else "", boxed("notice") if rng.random() < 0.25 else "", boxed("ad") if rng.random() < 0.4 else ""]
    side = boxed("side", tag("aside")) if rng.random() < 0.4 else ""
    after = [comments() if rng.random() < 0.25 else "", form() if rng.random() < 0.2 else "", boxed("social") if rng.random() < 0.2 else "", boxed("ad") if rng.random() < 0.2 else "", footer() if rng.random() < 0.75 else ""]
    middle = side + main if rng.random() < 0.4 else main + side
    if rng.random() < 0.35:
        middle = el("div", "M", middle, rng.choice(["", ' class="wrapper"', ' class="container"', ' id="page"']))
    return f'<html><head><title>{short()}</title></head><body data-y="M">{"".join(before)}{middle}{"".join(after)}</body></html>'


@functools.lru_cache(4)
def train(pages: int = 500, seed: int = 11):
    """The two ensembles, from so many made-up pages."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = Page(sample_page(rng))
        x = features(page)
        keep = [k for k, y in enumerate(page.label) if k and y and x[k, 0] > 0]
        xs.append(x[keep])
        ys += [page.label[k] for k in keep]
    x, y = np.vstack(xs), np.array(ys)
    held = y != "B"
    return boost(x, (y == "B").astype(float)), boost(x[held], (y[held] == "C").astype(float), rounds=25)


def texts_of(pages: list[Page], model) -> list[str]:
    """Main text of each page."""
    xs = [features(p) for p in pages]
    x = np.vstack(xs)
    drop, content = log_odds(model[0], x), log_odds(model[1], x)
    out, at = [], 0
    for page, f in zip(pages, xs):
        n = len(page.tag)
        used = (f[:, 0] > 0).tolist()
        label = decode(page.parent, used, drop[at : at + n], content[at : at + n])
        at += n
        out.append("\n".join(t for t, k in zip(page.blocks, page.owner) if label[k] == 1 and page.tag[k] not in NOT_TEXT))
    return out


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text (blocks joined by a line feed, empty if none), n_chars (code points).

    Null and empty html give an empty text; so does a page without content.  Rows are read one by one, so ids may be
    null or repeated; empty tables give no rows; extra columns are ignored.  Unclosed and crossed tags are mended as far
    as text needs it; nothing is cut, however long a page is.
    """
    model = pages.sparkSession.sparkContext.broadcast(train())
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            source, out = batch.column("html").to_pylist(), []
            for i in range(0, len(source), 256):
                out += texts_of([Page(s or "") for s in source[i : i + 256]], model.value)
            sizes = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(bounded(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
