"""Text, cards, links and ids out of landed HTML.

Markup is cut into tags and texts once, and folds walk the nesting, so containers and
cards come out whole. Void and unclosed tags, either case and attributes without quotes
are fine, which is why no XML reader is used.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmatch import fixed
from postmatch.functions.arrays import bind, each, keep, quoted
from postmatch.functions.text import squeeze, strip

NAMED_ENTITIES = {
    "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·",
    "&bull;": "•", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'",
}

_MARK = "\x01"
_UNSEEN = (
    r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|!--.*?-->"
    r"""|/?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)"""
)
_ANCHOR = r"""(?is)<a(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_BASE = r"(?is)^<base(?=[\s/>])"
#: Comments, scripts, tags and the texts between them, in order and whole.
_PIECE = (
    r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
    r"""|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[^>]*>|[^<]+|<"""
)
#: Elements that do not part the text around them.
_INLINE = (
    r"(?is)</?(?:a|abbr|b|bdi|bdo|cite|code|data|dfn|em|font|i|kbd|mark|q|s|samp|small|span|strong"
    r"|sub|sup|time|u|var|wbr)(?=[\s/>])[^>]*>"
)


def _attribute_pattern(name: str) -> str:
    """Pattern of an attribute, quoted or not; one of three groups has its value."""
    return rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


_HREF = _attribute_pattern("href")
_CARD_ID = _attribute_pattern(fixed.ID_ATTRIBUTE)


def _value(tag: str, name: str) -> str:
    """SQL for the value of a tag's attribute; absent gives the empty string."""
    pattern = quoted(_attribute_pattern(name))
    return "concat(" + ", ".join(f"regexp_extract({tag}, {pattern}, {k})" for k in (1, 2, 3)) + ")"


def _lists_class(tag: str, css_class: str) -> str:
    """SQL for whether a tag's class attribute lists this class among others."""
    return f"array_contains(split({_value(tag, 'class')}, '[ \\\\t\\\\r\\\\n\\\\f]+'), {quoted(css_class)})"


class Element(NamedTuple):
    """Which element is meant: by tag name, by class, or by both."""

    tag: str | None = None
    css_class: str | None = None

    def matches(self, tag: str, name: str) -> str:
        wanted = [f"{name} = {quoted(self.tag)}"] if self.tag else []
        wanted += [_lists_class(tag, self.css_class)] if self.css_class else []
        return " AND ".join([f"NOT startswith({name}, '/')", *wanted])


DESCRIPTION = Element(css_class=fixed.DESCRIPTION_CLASS)


def _pieces(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_PIECE), F.lit(0))


def _named(names: str) -> str:
    """SQL for the tags of ``b.p`` with their places and lower-case names."""
    pattern = quoted(rf"(?i)^<(/?(?:{names}))(?=[\s/>])")
    return (
        f"filter(transform(b.p, (x, i) -> struct(i AS at, lower(regexp_extract(x, {pattern}, 1)) AS name, "
        "x AS tag)), t -> t.name NOT IN ('', 'script', 'style'))"
    )


def content(html: Column, element: Element = DESCRIPTION) -> Column:
    """Markup inside the first such element, up to the tag that closes it.

    Elements of the same name inside are counted, so the content is whole; one that
    is never closed ends with the page. No such element gives the empty string.
    """
    opened = bind(
        "b",
        f"""struct(b.p, b.tags, get(filter(b.tags, t -> {element.matches('t.tag', 't.name')}), 0) AS first)""",
        p=_pieces(html), tags=bind("b", _named("[a-z][^\\s/>]*"), p=_pieces(html)),
    )
    closed = bind(
        "b",
        """struct(b.o.p, b.o.first, aggregate(
            filter(b.o.tags, t -> t.at > b.o.first.at
                AND (t.name = b.o.first.name OR t.name = concat('/', b.o.first.name))),
            struct(1 AS depth, -1 AS upto),
            (a, t) -> CASE WHEN a.upto >= 0 THEN a
                WHEN t.name = b.o.first.name THEN struct(a.depth + 1 AS depth, -1 AS upto)
                WHEN a.depth > 1 THEN struct(a.depth - 1 AS depth, -1 AS upto)
                ELSE struct(0 AS depth, t.at AS upto) END).upto AS upto)""",
        o=opened,
    )
    inside = bind(
        "b",
        """IF(b.c.first IS NULL, '', array_join(slice(b.c.p, b.c.first.at + 2,
            IF(b.c.upto < 0, size(b.c.p), b.c.upto) - b.c.first.at - 1), ''))""",
        c=closed,
    )
    return F.coalesce(inside, F.lit(""))


def decode_entities(text: Column, named: Mapping[str, str] = NAMED_ENTITIES) -> Column:
    """Numeric and the given named references; ``&amp;`` last, so nothing decodes twice."""
    decoded = "b.text"
    for opening, digits, radix in (("&#", r"(\\d{1,7})", 10), ("&#x", "([0-9a-fA-F]{1,6})", 16)):
        character = f"decode(unhex(lpad(conv(code, {radix}, 16), 8, '0')), 'UTF-32')"
        decoded = f"""aggregate(
            array_distinct(regexp_extract_all(b.text, '{opening}{digits};', 1)), {decoded},
            (done, code) -> replace(done, concat('{opening}', code, ';'), {character}))"""
    decoded = f"IF(contains(b.text, '&#'), {decoded}, b.text)"
    for reference, plain in [*named.items(), ("&amp;", "&")]:
        decoded = f"replace({decoded}, {quoted(reference)}, {quoted(plain)})"
    plain_case = F.regexp_replace(text, "&#X", "&#x")
    return bind("b", f"IF(contains(b.text, '&'), {decoded}, b.text)", text=plain_case)


def markup_text(markup: Column) -> Column:
    """Text nodes of markup joined by one space and stripped; scripts are not text."""
    marked = F.regexp_replace(markup, _UNSEEN, _MARK)
    return strip(decode_entities(F.regexp_replace(marked, f"{_MARK}+", " ")))


def container_text(html: Column, element: Element = DESCRIPTION) -> Column:
    """Text of the first such element; no such element gives the empty string."""
    return markup_text(content(html, element))


def cards(html: Column, scope: str | None = fixed.RESULTS_ID) -> Column:
    """The markup of every result card of a page, in page order.

    A card is an item of an unordered list inside the ``main`` element with the id
    ``scope``; without a scope, of any unordered list. Lists are walked with a stack of
    open lists and items, so an item holds its inner lists whole, and these items are
    cards too. The next item or the list's end closes an item that has no end tag.
    """
    scoped = "TRUE" if scope is None else "exists(c.kept, s -> s.k = 'scope')"
    is_scope = "FALSE" if scope is None else f"{_value('t.tag', 'id')} = {quoted(scope)}"
    # Where the stack is cut when a tag comes, and what is pushed then.
    cut = """CASE
        WHEN t.name IN ('li', '/li') THEN size(a.stack) - IF(get(a.stack, size(a.stack) - 1).k = 'li', 1, 0)
        WHEN t.name = '/main' THEN size(a.stack) - array_position(
            reverse(transform(a.stack, s -> IF(s.k IN ('main', 'scope'), 'main', ''))), 'main')
        WHEN startswith(t.name, '/') THEN CASE
            WHEN get(a.stack, size(a.stack) - 1).k = substring(t.name, 2) THEN size(a.stack) - 1
            WHEN get(a.stack, size(a.stack) - 1).k = 'li'
                AND get(a.stack, size(a.stack) - 2).k = substring(t.name, 2) THEN size(a.stack) - 2
            ELSE size(a.stack) END
        ELSE size(a.stack) END"""
    step = f"""get(transform(array({cut}), n -> get(transform(array(struct(
            slice(a.stack, 1, CAST(n AS INT)) AS kept,
            slice(a.stack, CAST(n AS INT) + 1, size(a.stack)) AS gone)), c -> struct(
        IF(startswith(t.name, '/'), c.kept, concat(c.kept, array(struct(
            CASE WHEN t.name = 'main' AND {is_scope} THEN 'scope' ELSE t.name END AS k, t.at AS at,
            t.name = 'li' AND coalesce(get(c.kept, size(c.kept) - 1).k = 'ul', FALSE) AND {scoped} AS card)))) AS stack,
        concat(a.done, transform(filter(c.gone, s -> s.card), s -> struct(
            s.at AS at, t.at - IF(t.name = '/li', 0, 1) AS upto))) AS done)), 0)), 0)"""
    walked = bind(
        "b",
        f"""struct(b.p, aggregate({_named('ul|ol|menu|li|main')}, struct(
            CAST(array() AS array<struct<k: string, at: int, card: boolean>>) AS stack,
            CAST(array() AS array<struct<at: int, upto: int>>) AS done),
            (a, t) -> {step}) AS w)""",
        p=_pieces(html),
    )
    return bind(
        "b",
        """transform(array_sort(concat(b.r.w.done, transform(filter(b.r.w.stack, s -> s.card),
                s -> struct(s.at AS at, size(b.r.p) - 1 AS upto)))),
            d -> array_join(slice(b.r.p, d.at + 1, d.upto - d.at + 1), ''))""",
        r=walked,
    )


def card_text(card: Column) -> Column:
    """All text of a card on one line, case kept.

    As in a browser, inline elements do not part words and all others do.
    """
    seen = F.regexp_replace(F.coalesce(card, F.lit("")), _INLINE, "")
    return squeeze(markup_text(seen))


def _attribute(tag: Column, pattern: str) -> Column:
    """Value of an attribute, or null where the tag does not have it."""
    found = F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))
    return F.when(F.regexp_like(tag, F.lit(pattern)), found)


def href(card: Column, marker: str = fixed.LINK_MARKER,
         css_class: str = fixed.LINK_CLASS) -> Column:
    """Raw link of a card: by marker in the address, else by class, else any."""
    tags = F.regexp_extract_all(F.coalesce(card, F.lit("")), F.lit(_ANCHOR), F.lit(0))
    anchors = each(
        keep(tags, f"a -> regexp_like(a, {quoted(_HREF)})"),
        f"a -> struct({_value('a', 'href')} AS href, {_lists_class('a', css_class)} AS listed)",
    )
    pick = bind(
        "b",
        f"""coalesce(
            get(filter(b.anchors, a -> contains(a.href, {quoted(marker)})), 0),
            get(filter(b.anchors, a -> a.listed), 0),
            get(b.anchors, 0)).href""",
        anchors=anchors,
    )
    return F.coalesce(strip(F.replace(pick, F.lit("&amp;"), F.lit("&"))), F.lit(""))


def _plain_ascii(address: Column) -> Column:
    """Percent-encode what an address may not hold as is."""
    pieces = F.regexp_extract_all(
        address, F.lit(r"[^\x21-\x7e]+|[\x21-\x7e]+"), F.lit(0)
    )
    encoded = each(
        pieces,
        r"p -> IF(regexp_like(p, '[^\\x21-\\x7e]'), replace(url_encode(p), '+', '%20'), p)",
    )
    return F.array_join(encoded, "")


def _without_dots(address: Column) -> Column:
    """Take ``.`` and ``..`` steps out of an address's path."""
    parts = bind(
        "b",
        r"""struct(regexp_extract(b.a, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin,
            split(regexp_extract(b.a, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/') AS steps,
            regexp_extract(b.a, '^[^?#]*(.*)$', 1) AS rest)""",
        a=address,
    )
    walked = bind(
        "b",
        """concat(b.p.origin, array_join(aggregate(b.p.steps, array(''), (done, s) -> CASE
                WHEN s = '..' THEN slice(done, 1, greatest(size(done) - 1, 1))
                WHEN s = '.' THEN done ELSE concat(done, array(s)) END), '/'),
            IF(element_at(b.p.steps, -1) IN ('.', '..'), '/', ''), b.p.rest)""",
        p=parts,
    )
    has_dots = F.regexp_like(address, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/\.\.?(?:[/?#]|$)"))
    return F.when(has_dots, walked).otherwise(address)


def absolute(link: Column, page_url: Column) -> Column:
    """Resolve a link against the page it stands on, as a browser would."""
    scheme = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_extract(page_url, r"^([^?#]*)", 1)
    folder = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    resolved = (
        F.when(link == "", "")
        .when(F.regexp_like(link, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.startswith(link, F.lit("?")), F.concat(bare, link))
        .when(
            F.startswith(link, F.lit("#")),
            F.concat(F.regexp_extract(page_url, r"^([^#]*)", 1), link),
        )
        .otherwise(F.concat(folder, link))
    )
    return _plain_ascii(_without_dots(resolved))


def base_url(html: Column, page_url: Column) -> Column:
    """The address that a page's links are relative to: the first ``base`` element with
    a link says so, itself relative to the page, else it is the page's own."""
    tags = keep(_pieces(html), f"x -> regexp_like(x, {quoted(_BASE)})")
    named = F.get(keep(tags, f"x -> {_value('x', 'href')} != ''"), F.lit(0))
    found = F.replace(bind("b", _value("b.x", "href"), x=named), F.lit("&amp;"), F.lit("&"))
    address = F.nullif(strip(found), F.lit(""))
    return F.when(F.regexp_like(html, F.lit(_BASE.replace("^", ""))) & address.isNotNull(),
                  absolute(address, page_url)).otherwise(page_url)


def card_link(card: Column, page_url: Column, marker: str = fixed.LINK_MARKER,
              css_class: str = fixed.LINK_CLASS) -> Column:
    """Absolute link of a card, or the empty string."""
    return absolute(href(card, marker, css_class), page_url)


def card_id(card: Column, link: Column, pattern: str = fixed.ID_IN_LINK) -> Column:
    """Posting id: the card's own or a nested id attribute, else digits of its link.

    The first tag carrying the attribute is the card itself whenever it has one.
    A card's own empty attribute does not count; a nested empty one does.
    """
    opening = F.regexp_extract(card, r"(?s)^\s*(<[^>]*>)", 1)
    own = F.nullif(_attribute(opening, _CARD_ID), F.lit(""))
    inside = F.substring(card, F.length(opening) + 1, F.length(card))
    nested = _attribute(inside, _CARD_ID)
    from_link = F.regexp_extract(link, pattern, 1)
    return strip(F.coalesce(own, nested, from_link, F.lit("")))
