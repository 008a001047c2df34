"""Labelled pages for the content model: layouts of the web with made-up words, drawn from a seed.

Elements say data-main="1" or "0" for themselves and what is below them.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ter ran so del fi gra nu pe vor sti al en qui bo sha tal um dre".split()
#: (tag, attributes) of things that aren't the article, by kind. Several of each, as sites differ.
_FRAMES = {
    "menu": ['nav', 'nav class="main-nav"', 'div class="menu"', 'div id="nav"', 'ul class="navigation"', 'div class="navbar topbar"', 'div role="navigation"', 'div class="breadcrumbs"', 'div class="pagination"', 'nav class="breadcrumb"', 'div class="toc"', 'menu', 'div class="hauptnavigation"', 'ul class="menue"', 'div class="menu-principal"', 'nav class="fil-ariane"', 'div class="navegacion"', 'div class="links"'],
    "header": ['header', 'header', 'header', 'div id="header"', 'div class="site-header"', 'header class="masthead"', 'div class="top-bar"', 'div role="banner"', 'div class="logo branding"', 'header id="page-header"', 'div class="kopf kopfzeile"', 'div class="en-tete"', 'div class="cabecera"'],
    "footer": ['footer', 'div id="footer"', 'div class="site-footer"', 'footer class="bottom"', 'div role="contentinfo"', 'div class="copyright legal"', 'div class="foot"', 'div class="fuss fusszeile"', 'div class="pied pied-de-page"', 'div class="pie"', 'div class="impressum"'],
    "sidebar": ['aside', 'div class="sidebar"', 'div id="sidebar"', 'aside class="related"', 'div class="widget"', 'div class="right-rail column"', 'section class="recommended"', 'div class="most-read popular"', 'div role="complementary"', 'div class="related-posts links"', 'div class="share social"', 'div class="author-box bio"', 'div class="tags"', 'div class="seitenleiste"', 'div class="randspalte"', 'div class="barre-laterale colonne"', 'div class="barra-lateral"', 'div class="meistgelesen"', 'div class="a-lire-aussi"', 'div class="mas-leidas"', 'td class="side"', 'td class="left" width="150"'],
    "notice": ['div class="cookie-banner"', 'div id="cookie-consent"', 'div class="notice"', 'div role="alert"', 'div class="gdpr privacy"', 'div class="alert message"', 'div role="dialog" class="modal"', 'dialog', 'div class="popup overlay"', 'div class="disclaimer"', 'section class="cookie notice"', 'p class="notice"', 'div class="paywall subscribe"', 'div class="hinweis"', 'div class="avis"', 'div class="aviso"', 'div id="cookie-hinweis"', 'div id="bandeau-cookies"', 'div id="cookie-banner"', 'div class="datenschutz"'],
    "advert": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div id="ad-slot"', 'aside class="advertisement"', 'div class="sponsored promo"', 'ins class="adsbygoogle"', 'section class="promotion"', 'div class="banner-ad"', 'p class="ad"', 'div class="adBox"', 'div class="werbung"', 'div class="anzeige"', 'div class="reklame"', 'div class="publicite"', 'div class="pub"', 'div class="publicidad"', 'div class="anuncio"', 'aside class="werbung"', 'p class="anzeige"', 'div class="sponsorise"'],
    "form": ['form', 'form class="search"', 'form id="login"', 'div class="newsletter signup"', 'form class="newsletter"', 'div class="contact-form"', 'fieldset', 'search', 'div role="search"', 'div class="suche"', 'div class="recherche"', 'div class="buscar"', 'div class="anmeldung"'],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'section id="disqus_thread"', 'ol class="commentlist"', 'div class="user-comments replies"', 'section class="reader-comments"', 'div class="discussion responses"', 'ul class="comments"', 'aside class="comments"', 'section class="kommentare"', 'div id="kommentare"', 'section class="commentaires"', 'div class="comentarios"', 'div class="avis-lecteurs reponses"', 'ol class="leserbriefe kommentarliste"'],
}
_LAYOUTS = ["", "", "", "", ' class="row"', ' class="col-12 inner"', ' class="wrapper"', ' class="container"', ' id="w1"', ' style="margin:0"']
_ARTICLES = ['article', 'article', 'article', 'article', 'article', 'article class="post"', 'main', 'main id="content"', 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry-content"', 'section class="story"', 'div class="article"', 'div class="article-body text"', 'div role="main"', 'section', 'div class="main"', 'div', 'td class="text"', 'td', 'td', 'td valign="top"', 'div class="inhalt"', 'div class="artikel"', 'div class="contenu"', 'div class="contenido"', 'div class="row"', 'div class="col-8"']


def labelled_pages(count: int = 1000, seed: int = 7) -> list[str]:
    return [_page(random.Random(seed * 100_003 + k)) for k in range(count)]


def _words(r: random.Random, least: int, most: int) -> str:
    made = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(least, most))]
    out, start = [], True
    for w in made:
        out.append(w.capitalize() if start else w)
        start = r.random() < 0.12
        if start:
            out[-1] += "."
        elif r.random() < 0.08:
            out[-1] += ","
    return " ".join(out)


def _sentences(r: random.Random, short: bool = False) -> str:
    text = _words(r, *r.choice([(1, 4), (5, 20), (5, 20), (20, 60)] if short else [(1, 4), (5, 20), (20, 60), (60, 150)])) + r.choice(["", ".", ".", "!", "?"])
    if r.random() < 0.3:
        parts = text.split(" ")
        at = r.randrange(len(parts))
        parts[at] = r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(parts[at])
        text = " ".join(parts)
    return text


def _links(r: random.Random) -> str:
    return "<ul>" + "".join(f'<li><a href="/{_words(r, 1, 1)}">{_words(r, 1, 3)}</a></li>' for _ in range(r.randint(2, 8))) + "</ul>"


def _framed(r: random.Random, kind: str, frame: str | None = None, cell: bool = False) -> str:
    frame = frame or r.choice(_FRAMES[kind])
    tag = frame.split(" ")[0]
    para = "<p>" if r.random() < 0.8 else "<div>"
    paragraph = lambda: f"{para}{_sentences(r, kind != 'comments')}{para.replace('<', '</')}"
    if tag in ("ul", "ol", "menu"):
        item = (lambda: f"<p>{_sentences(r)}</p>") if kind == "comments" else (lambda: f'<a href="#">{_words(r, 1, 3)}</a>')
        inside = "".join(f"<li>{item()}</li>" for _ in range(r.randint(2, 6)))
    elif tag == "p":
        inside = _sentences(r, True)
    elif kind == "menu":
        inside = r.choice([_links, lambda r: " ".join(f'<a href="/">{_words(r, 1, 2)}</a>' for _ in range(r.randint(2, 6)))])(r)
    elif kind == "form":
        inside = r.choice(["", f"<label>{_words(r, 1, 3)}</label>"]) + '<input type="text">' + r.choice(["", paragraph(), f"<select><option>{_words(r, 1, 1)}</option><option>{_words(r, 1, 1)}</option></select>", f"<textarea>{_words(r, 1, 4)}</textarea>"]) + f"<button>{_words(r, 1, 2)}</button>"
    elif kind == "comments":
        box = r.choice(["div", "div", 'div class="comment"', "li", 'article class="comment"', "p"])
        body = (lambda: _sentences(r)) if box == "p" else (lambda: r.choice([f"<h4>{_words(r, 1, 2)}</h4>", f"<b>{_words(r, 1, 2)}</b>", ""]) + f"<p>{_sentences(r)}</p>")
        inside = r.choice(["", f"<h3>{_words(r, 1, 3)}</h3>"]) + "".join(f"<{box}>{body()}</{box.split(' ')[0]}>" for _ in range(r.randint(1, 5)))
    elif kind == "header":
        inside = r.choice([_words(r, 1, 4), f"<h1>{_words(r, 1, 3)}</h1>", f"<h2>{_words(r, 1, 3)}</h2>", f"<h1>{_words(r, 1, 2)}</h1>", f"<p>{_words(r, 1, 4)}</p>", f"<h2>{_words(r, 1, 3)}</h2>" + paragraph(), f'<a href="/">{_words(r, 1, 3)}</a>' + _framed(r, "menu")])
    else:
        inside = r.choice([lambda: _sentences(r, True), lambda: paragraph() + r.choice(["", paragraph()]), lambda: f"<h3>{_words(r, 1, 4)}</h3>" + _links(r), lambda: f"<h2>{_words(r, 1, 4)}</h2>" + paragraph() + paragraph(), lambda: "&copy; 2024 " + _words(r, 2, 14), lambda: f"<h3>{_words(r, 1, 4)}</h3>" + "".join(paragraph() for _ in range(r.randint(1, 5)))])()
    if tag not in ("ul", "ol", "menu", "p", "table") and r.random() < 0.25:
        inside = _wrapped(r, inside)
    made = f'<{frame} data-main="0">{inside}</{tag}>'
    return f"<table><tr>{made}</tr></table>" if tag == "td" and not cell else made


def _wrapped(r: random.Random, inside: str) -> str:
    """Within none to six elements that only lay out the page."""
    for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2, 3, 6])):
        inside = f"<div{r.choice(_LAYOUTS)}>{inside}</div>"
    return inside


def _nested(r: random.Random, parts: list[str]) -> str:
    """The parts, some of them in wrappers, in halves that lie in wrappers of their own, and so on."""
    if len(parts) < 2 or r.random() < 0.25:
        return "".join(_wrapped(r, p) if r.random() < 0.3 else p for p in parts)
    half = r.randint(1, len(parts) - 1)
    return "".join(f"<div{r.choice(_LAYOUTS)}>{_nested(r, p)}</div>" for p in (parts[:half], parts[half:]))


def _terraced(r: random.Random, parts: list[str]) -> str:
    """The parts one in another: each level has some, then what isn't the article, beside the next level."""
    inside = ""
    for k in range(r.randint(2, 4), -1, -1):
        own = "".join(parts.pop() for _ in range(min(len(parts), r.choice([0, 0, 1])))) if k else "".join(parts)
        beside = r.choice(["", _framed(r, r.choice(["advert", "advert", "sidebar", "form"]))])
        inside = own + (f"<div{r.choice(_LAYOUTS)}>{inside}</div>" + beside if inside or beside else "")
        if r.random() < 0.3:
            inside = '<img src="/p.png">' + inside
    return inside


def _article(r: random.Random, bare: bool = False) -> str:
    frame = r.choice(_ARTICLES) if not bare else "body"
    title = f"<{r.choice(['h1', 'h1', 'h2'])}>{_words(r, 1, 9)}</h1>"
    title = title[:4] + title[4:].replace("</h1>", f"</{title[1:3]}>")
    if r.random() < 0.02:
        title = f"<header>{title}</header>"
    parts = [title] if r.random() < 0.8 else []
    for _ in range(r.choice([1, 1, 1, 2, 3, 4, 6, 9, 16])):
        x = r.random()
        if x < 0.68:
            parts.append(f"<p>{_sentences(r)}" + ("</p>" if r.random() < 0.9 else ""))
        elif x < 0.74:
            parts.append(f"<h2>{_words(r, 1, 6)}</h2>")
        elif x < 0.80:
            parts.append(f"<ul>{''.join(f'<li>{_sentences(r)}</li>' for _ in range(r.randint(2, 5)))}</ul>")
        elif x < 0.84:
            parts.append(f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(_sentences(r))}</blockquote>")
        elif x < 0.87:
            parts.append(f"<pre>{_words(r, 2, 12)}</pre>")
        elif x < 0.90:
            parts.append(f"<table><tr><td>{_words(r, 1, 3)}</td><td>{_words(r, 1, 3)}</td></tr><tr><td>{_words(r, 1, 3)}</td><td>{_words(r, 1, 3)}</td></tr></table>")
        elif x < 0.93:
            parts.append(f'<figure><img src="/i.png"><figcaption>{_words(r, 3, 12)}</figcaption></figure>')
        elif x < 0.96:
            parts.append(f"<div>{_sentences(r)}</div>" if r.random() < 0.5 else f"<div><p>{_sentences(r)}</p><p>{_sentences(r)}</p></div>")
        else:
            parts.append(_framed(r, r.choice(["advert", "sidebar", "form", "notice"])))
    if r.random() < 0.15:
        parts.append(_framed(r, r.choice(["comments", "footer", "sidebar"])))
    x = r.random()
    if x < 0.22 and len(parts) > 1:
        body = parts[0] + _terraced(r, parts[:0:-1])
    elif x < 0.3 and len(parts) > 1:
        # The heading in a column, the rest in another within it, maybe with a picture.
        body = f'<div{r.choice(_LAYOUTS)}>{parts[0]}<div{r.choice(_LAYOUTS)}>{r.choice(["", "<img src=/p.png>"])}<div>{"".join(parts[1:])}</div></div></div>'
    else:
        body = _nested(r, parts) if x < 0.62 else "".join(parts)
    if bare:
        return body
    if frame.startswith("td") and r.random() < 0.7:
        # A table lays out the page: cells of links beside the article's.
        cell = lambda: _framed(r, r.choice(["menu", "sidebar"]), r.choice(["td", "td", 'td class="side"', 'td width="150" valign="top"']), cell=True)
        cells = [f'<{frame.split(" ")[0]}{r.choice(["", "", _LAYOUTS[5]])} data-main="1">{body}</td>']
        cells = ([cell()] if r.random() < 0.8 else []) + cells + ([cell()] if r.random() < 0.5 else [])
        return f"<table><tr>{''.join(cells)}</tr></table>"
    inside = f'<{frame} data-main="1">{_wrapped(r, body) if r.random() < 0.3 else body}</{frame.split(" ")[0]}>'
    return f"<table><tr>{inside}</tr></table>" if frame.startswith("td") else inside


def _page(r: random.Random) -> str:
    before = [_framed(r, k) for k in ("notice", "header", "menu", "advert", "menu") if r.random() < 0.45]
    beside = [_framed(r, k) for k in ("sidebar", "advert", "form") if r.random() < 0.35]
    after = [_framed(r, k) for k in ("advert", "comments", "sidebar", "form", "notice", "footer") if r.random() < 0.4]
    bare = r.random() < 0.15  # the article's blocks lie in the body itself
    middle = [_article(r, bare)]
    if bare:
        beside, before, after = [], before[:2], after[-2:]
    elif r.random() < 0.5:
        middle = middle + beside if r.random() < 0.6 else beside + middle
    else:
        before += beside
    body = "".join(before) + ("{}" if bare else r.choice(["{}", "{}", "<div>{}</div>", '<div class="container wrapper">{}</div>', '<div id="page"><div class="row">{}</div></div>', '<main>{}</main>'])).format("".join(middle)) + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{_words(r, 1, 6)}</title><style>p{{margin:0}}</style></head><body data-main=\"{int(bare)}\">{body}</body></html>"
