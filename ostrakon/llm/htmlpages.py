"""Labelled training pages for the extraction model, made from a seed.

Each element of a page carries ``data-y``: 1 inside the main text, 0 outside.
Layouts, names of classes and order of parts vary, and some pages lack
landmarks, closing tags or classes, so the model can't lean on one sign.
"""

from __future__ import annotations

import random

# Fixed word lists: common names of page parts.
MENU = "nav navbar menu navigation topnav mainmenu main-menu breadcrumbs breadcrumb tabs toolbar site-nav primary-nav pagination pager skip-links".split()
HEADER = "header masthead site-header page-header topbar banner-top branding logo hero-bar".split()
FOOTER = "footer site-footer page-footer bottom colophon copyright legal credits footer-links".split()
SIDEBAR = "sidebar side-bar aside secondary rail right-column left-column widget widgets related related-posts recommended most-read trending popular tags tag-cloud toc".split()
NOTICE = "notice cookie cookie-banner cookies consent gdpr alert message warning disclaimer announcement popup modal overlay paywall subscribe-wall privacy-notice".split()
ADVERT = "ad ads advert advertisement adsbygoogle ad-slot sponsored sponsor promo promotion banner banner-ad outbrain taboola partner commercial".split()
FORM = "newsletter signup subscribe search search-form login contact-form register feedback poll".split()
SHARE = "share social social-links sharing share-buttons follow-us".split()
COMMENTS = "comments comment comment-list commentlist reader-comments responses replies discussion disqus user-comments comment-thread reactions".split()
CONTENT = "content article post entry main story article-body post-content entry-content story-body text body-text article-content page-content".split()
LINKS = "Home About Contact News Sport Archive Privacy Terms Help Login Shop Blog Next Previous Top More".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "etaoinshrdlucmfwyp"
        self.vocabulary = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 9))) for _ in range(300)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.vocabulary) for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        s = self.words(2, 18)
        if self.r.random() < 0.3:
            s += ", " + self.words(2, 9)
        return s.capitalize() + self.r.choice(["."] * 5 + ["!", "?", ".&amp;", " &quot;x&quot;.", ""])

    def prose(self, low: int = 1, high: int = 7) -> str:
        kind = self.r.random()
        if kind < 0.06:  # without sentences, of any length
            return self.words(1, self.r.choice([5, 40, 400, 1500]))
        if kind < 0.1:
            return self.words(1, self.r.choice([20, 200])).upper().replace(" ", self.r.choice(["!! ", " | ", "$$$ ", " "]))
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def name(self, words: list[str]) -> str:
        w = self.r.choice(words)
        if self.r.random() < 0.25:
            w += self.r.choice(["-1", "-box", "-wrap", "_inner", "-container", " clearfix", " col-4", "2"])
        return f' {self.r.choice(["class", "class", "class", "id"])}="{w}"'

    def el(self, tag: str, y: int, body: str, attrs: str = "", closed: bool = True) -> str:
        return f'<{tag}{attrs} data-y="{y}">{body}' + (f"</{tag}>" if closed else "")

    def links(self, y: int, n: int) -> str:
        return self.el("ul", y, "".join(self.el("li", y, self.el("a", y, self.r.choice([self.r.choice(LINKS), self.words(1, 4)]), ' href="/x"'), closed=self.r.random() < 0.9) for _ in range(n)))

    def inline(self, text: str, y: int) -> str:
        words = text.split(" ")
        if len(words) > 5 and self.r.random() < 0.4:
            i = self.r.randrange(len(words) - 2)
            tag = self.r.choice(["a", "b", "em", "i", "strong", "span", "code"])
            words[i : i + 2] = [self.el(tag, y, " ".join(words[i : i + 2]), ' href="/y"' if tag == "a" else "")]
        return " ".join(words)

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            h = self.el(r.choice(["h1", "h1", "h2"]), 1, self.words(2, 9).capitalize())
            out.append(self.el("header", 1, h) if r.random() < 0.08 else h)
        loose = r.random() < 0.3
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.78:
                tag = "div" if r.random() < 0.05 else "p"
                text = self.inline(self.prose(1, 6) if r.random() < 0.85 else self.words(1, 3) + ".", 1)
                if r.random() < 0.12:
                    text = self.el("b", 1, text + self.el("br", 1, "", closed=False), closed=False)
                    out.append(self.el(tag, 1, text, closed=False))
                else:
                    out.append(self.el(tag, 1, text, closed=not (loose and tag == "p")))
            elif kind < 0.84:
                out.append(self.el(r.choice(["h2", "h3"]), 1, self.words(1, 6).capitalize()))
            elif kind < 0.9:
                out.append(self.el(r.choice(["ul", "ol"]), 1, "".join(self.el("li", 1, self.prose(1, 2), closed=not loose) for _ in range(r.randint(1, 5)))))
            elif kind < 0.94:
                out.append(self.el("blockquote", 1, self.el("p", 1, self.prose())))
            elif kind < 0.97:
                out.append(self.el("table", 1, "".join(self.el("tr", 1, "".join(self.el("td", 1, self.words(1, 5)) for _ in range(3))) for _ in range(r.randint(1, 4)))))
            else:
                out.append(self.el("pre", 1, self.words(3, 30)))
            if r.random() < 0.06:
                out.append(self.clutter(inside=True))
        return "".join(out)

    def clutter(self, inside: bool = False) -> str:
        r = self.r
        kind = r.choice(["ad", "ad", "notice", "form", "share", "side", "comments"] if inside else ["ad", "ad", "notice", "form", "share", "side", "side", "comments", "comments", "menu"])
        text = lambda: self.el("p", 0, self.prose(1, 4)) if r.random() < 0.5 else self.prose(1, 3)
        if kind == "ad":
            return self.el(r.choice(["div", "div", "aside", "ins", "section"]), 0, text() if r.random() < 0.8 else self.el("a", 0, self.words(2, 8), ' href="/ad"'), self.name(ADVERT))
        if kind == "notice":
            return self.el(r.choice(["div", "div", "section", "p", "dialog"]), 0, self.prose(1, 3) + (self.el("button", 0, "OK") if r.random() < 0.5 else ""), self.name(NOTICE))
        if kind == "form":
            body = self.el("label", 0, self.words(1, 4)) + '<input type="text">' + self.el("button", 0, self.words(1, 2))
            if r.random() < 0.4:
                body = self.el("p", 0, self.prose(1, 2)) + body
            return self.el("form", 0, body, self.name(FORM) if r.random() < 0.6 else "") if r.random() < 0.7 else self.el("div", 0, self.el("form", 0, body), self.name(FORM))
        if kind == "share":
            return self.el(r.choice(["div", "ul", "p"]), 0, "".join(self.el("a", 0, self.words(1, 2), ' href="/s"') for _ in range(r.randint(2, 5))), self.name(SHARE))
        if kind == "side":
            body = (self.el("h3", 0, self.words(1, 4)) if r.random() < 0.6 else "") + (self.links(0, r.randint(2, 7)) if r.random() < 0.6 else self.el("p", 0, self.prose(1, 4)))
            return self.el("aside", 0, body, self.name(SIDEBAR) if r.random() < 0.5 else "") if r.random() < 0.5 else self.el(r.choice(["div", "section"]), 0, body, self.name(SIDEBAR))
        if kind == "comments":
            one = lambda: self.el(r.choice(["div", "li", "article", "p"]), 0, (self.el("span", 0, self.words(1, 2), ' class="author"') if r.random() < 0.5 else "") + (self.el("p", 0, self.prose(1, 4)) if r.random() < 0.7 else self.prose(1, 4)), self.name(COMMENTS) if r.random() < 0.6 else "")
            body = (self.el("h3", 0, self.words(1, 3)) if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6)))
            return self.el(r.choice(["div", "section", "ol", "aside"]), 0, body, self.name(COMMENTS))
        return self.menu()

    def menu(self) -> str:
        r = self.r
        body = self.links(0, r.randint(2, 9)) if r.random() < 0.75 else " | ".join(self.el("a", 0, r.choice(LINKS), ' href="/"') for _ in range(r.randint(2, 6)))
        return self.el("nav", 0, body, self.name(MENU) if r.random() < 0.3 else "") if r.random() < 0.6 else self.el("div", 0, body, self.name(MENU))

    def page(self) -> str:
        r = self.r
        top, bottom = [], []
        if r.random() < 0.5:
            inner = self.el(r.choice(["h1", "p", "div", "a"]), 0, self.words(1, 4)) + (self.menu() if r.random() < 0.4 else "")
            top.append(self.el("header", 0, inner, self.name(HEADER) if r.random() < 0.3 else "") if r.random() < 0.6 else self.el("div", 0, inner, self.name(HEADER)))
        if r.random() < 0.8:
            top.append(self.menu())
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            (top if r.random() < 0.5 else bottom).append(self.clutter())
        r.shuffle(top)
        if r.random() < 0.85:
            inner = "&copy; " + self.words(1, 8) + (self.links(0, 3) if r.random() < 0.4 else "") + (" &middot; " + self.sentence() if r.random() < 0.5 else "")
            if r.random() < 0.4:
                inner = self.el("p", 0, inner)
            bottom.append(self.el("footer", 0, inner, self.name(FOOTER) if r.random() < 0.3 else "") if r.random() < 0.7 else self.el("div", 0, inner, self.name(FOOTER)))
        main, shape = self.main(), r.random()
        if shape < 0.5:
            body = self.el("article", 1, main, self.name(CONTENT) if r.random() < 0.3 else "")
        elif shape < 0.62:
            body = self.el("main", 1, main)
        elif shape < 0.85:
            body = self.el(r.choice(["div", "section"]), 1, main, self.name(CONTENT))
        elif shape < 0.93:
            body = self.el("div", 1, main)
        else:
            body = main
        if r.random() < 0.15:
            body = self.el("main", 0, body + "".join(self.clutter() for _ in range(r.randint(1, 2))))
        elif r.random() < 0.25:
            body = self.el(r.choice(["main", "div"]), 0, body + (self.clutter() if r.random() < 0.5 else ""), r.choice(["", ' id="page"', ' class="wrapper"', ' class="container"', ' class="row"']))
        if r.random() < 0.08:  # fragments
            return body if r.random() < 0.5 else "".join(top) + body + "".join(bottom)
        head = f'<head><meta charset="utf-8"><title>{self.words(1, 6)}</title><style>p{{}}</style></head>'
        close = "</body></html>" if r.random() < 0.9 else ""
        return f'<!DOCTYPE html><html lang="en">{head}<body data-y="0">{"".join(top)}<!-- x -->{body}{"".join(bottom)}{close}'


def labelled_pages(n: int, seed: int = 0) -> list[str]:
    """``n`` pages; the same for the same seed."""
    return [_Maker(seed * 100_003 + i).page() for i in range(n)]
