"""Made-up pages whose main text is known: what the extraction model is trained on."""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren sto ber ta ly ing mor den fa su ri el an ber tor wis hal ne du cra pel os um via ger".split()
_ENTITIES = ("&amp;", "&nbsp;", "&quot;", "&eacute;", "&#8217;", "&lt;")


class PageMaker:
    """Random pages; MAIN marks stand around every block of main text and are taken out again by the reader."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 4, b: int = 18) -> str:
        s = self.words(a, b)
        if self.r.random() < 0.05:
            s += " " + self.r.choice(_ENTITIES)
        if self.r.random() < 0.08:
            s += f' <a href="/{self.word()}">{self.words(1, 3)}</a> {self.word()}'
        if self.r.random() < 0.06:
            s += f" <b>{self.words(1, 3)}</b>"
        return s.capitalize() + self.r.choice("...!?")

    def prose(self, a: int = 1, b: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def links(self, a: int = 3, b: int = 9) -> str:
        kind = self.r.random()
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(a, b))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if kind < 0.6 else self.r.choice((" | ", " ", " &middot; ")).join(items)

    def named(self, tags: str, names: str, body: str) -> str:
        """body in one of the elements, mostly with one of the names as its class, id or role."""
        tag, name = self.r.choice(tags.split()), self.r.choice(names.split())
        how = self.r.random()
        if how < 0.2 and tag not in ("div", "section"):
            return f"<{tag}>{body}</{tag}>"
        extra = self.r.choice(("", f" {self.word()}", f" {self.word()}-{self.word()}"))
        return f'<{tag} {"id" if how > 0.8 else "class"}="{name}{extra if how <= 0.8 else ""}">{body}</{tag}>'

    def main(self, text: str) -> str:
        return f"\x02{text}\x03"

    def content(self) -> str:
        """The blocks of an article, each marked."""
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.main(self.words(2, 9))}</h1>")
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.68:
                out.append(f"<p>{self.main(self.prose())}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.76:
                out.append(f"<h2>{self.main(self.words(1, 6))}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.main(self.sentence())}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{self.main(self.prose(1, 2))}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{self.main(self.words(1, 3))}</td><td>{self.main(self.words(1, 4))}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.97:
                out.append(f"<pre>{self.main(self.words(3, 15))}</pre>")
            else:
                out.append(f"<p><b>{self.main(self.words(2, 8))}<br><p>{self.main(self.prose())}</p>")
            if r.random() < 0.08:
                out.append(self.aside_inside())
        return "".join(out)

    def aside_inside(self) -> str:
        kind = self.r.randrange(4)
        if kind == 0:
            return self.named("div aside", "ad ads advert advertisement sponsored promo", self.prose(1, 2))
        if kind == 1:
            return self.named("div ul", "share sharing social", self.links(2, 4))
        if kind == 2:
            return self.named("aside div", "related sidebar recommended", f"<h3>{self.words(1, 3)}</h3>{self.links(2, 5)}")
        return self.named("form div", "newsletter subscribe signup", f"<p>{self.sentence()}</p><label>{self.word()}</label><input><button>{self.word()}</button>")

    def comments(self) -> str:
        each = "".join(self.r.choice((f'<div class="comment"><b>{self.word()}</b><p>{self.prose(1, 3)}</p></div>', f"<li><p>{self.prose(1, 3)}</p></li>")) for _ in range(self.r.randint(1, 6)))
        return self.named("section div ol", "comments comment-list commentlist discussion responses", f"<h3>{self.words(1, 2)}</h3>{each}")

    def page(self) -> str:
        r, before, after = self.r, [], []
        if r.random() < 0.85:
            before.append(self.named("nav nav div", "nav menu navigation navbar main-nav", self.links()))
        if r.random() < 0.5:
            before.append(self.named("header header div", "header site-header masthead topbar", f"<p>{self.words(1, 5)}</p>" + (self.links(2, 5) if r.random() < 0.5 else "")))
        if r.random() < 0.3:
            before.append(self.named("div div ul nav", "breadcrumb breadcrumbs", self.links(2, 4)))
        if r.random() < 0.45:
            before.append(self.named("div div section", "ad ads advert banner advertisement sponsored promo", self.prose(1, 3)))
        if r.random() < 0.3:
            (before if r.random() < 0.5 else after).append(self.named("div div aside", "cookie cookie-notice consent notice gdpr alert", f"<p>{self.prose(1, 2)}</p><button>{self.word()}</button>"))
        if r.random() < 0.3:
            (before if r.random() < 0.5 else after).append(self.named("form div", "search login signup newsletter", f"<label>{self.words(1, 3)}</label><input><p>{self.sentence()}</p>"))
        if r.random() < 0.45:
            (before if r.random() < 0.4 else after).append(self.named("aside aside div", "sidebar side widget related trending", f"<h3>{self.words(1, 3)}</h3>" + (self.links() if r.random() < 0.6 else f"<p>{self.prose(1, 4)}</p>")))
        body, own = self.content(), self.comments() if r.random() < 0.35 else ""
        inside = own if r.random() < 0.5 else ""
        if not inside and own:
            after.insert(0, own)
        kind = r.random()
        article = f"<article>{body}{inside}</article>" if kind < 0.5 else f"<main>{body}{inside}</main>" if kind < 0.62 else self.named("div div section", "content article post entry main story post-content article-body", body + inside)
        if r.random() < 0.3:
            article = self.named("div main section", "wrapper container page main", article)
        if r.random() < 0.85:
            after.append(self.named("footer footer div", "footer site-footer copyright legal", f"&copy; {self.words(1, 4)} &middot; {self.prose(1, 2)}" if r.random() < 0.6 else f"<p>{self.prose(1, 2)}</p>{self.links(2, 6)}"))
        html = f'<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{"".join(before)}<!-- {self.word()} -->{article}{"".join(after)}</body></html>'
        return html[: html.rindex("\x03") + 1 + r.randint(0, 20)] if r.random() < 0.08 else html
