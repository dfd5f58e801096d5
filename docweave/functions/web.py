"""Addresses, routing, dates and reasons for thin pages as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that are no page, and what betrays why a page is thin, in order of precedence.
BINARY_SUFFIXES = "csv zip tar gz exe xlsx docx".split()
BOT_SIGNS = ["just a moment...", "attention required! | cloudflare", "cf-browser-verification", "enable javascript and cookies to continue", "verify you are human", "checking your browser before accessing", "access denied", "captcha"]
COOKIE_SIGNS = ["cookiebot", "onetrust", "didomi", "quantcast", "trustarc", "accept all cookies", "aceptar todas las cookies", "cookie consent", "consentimiento de cookies", "manage cookie preferences", "we value your privacy"]
LOGIN_SIGNS = ["paywall", "subscribe to read", "subscribe to continue", "sign in to continue", "log in to view", "iniciar sesión", "inicia sesión para seguir leyendo", "suscríbete para seguir leyendo", "contenido exclusivo para suscriptores"]
SCRIPT_SIGNS = ['id="root"', 'id="app"', 'id="__next"', "you need to enable javascript", "javascript is required", "please enable javascript", "requires javascript"]
#: Characters of the source in which signs are looked for, and scripts that with a noscript mean a client-side page.
SOURCE_CHARS, MANY_SCRIPTS = 65_536, 5
#: Characters under which a page's content is thin.
THIN_CHARS = 500


def is_url(c: Column) -> Column:
    return F.lower(c).rlike("^https?://")


def domain(c: Column) -> Column:
    """Network location of an address, with port, without a leading www.; empty if there is none."""
    loc = F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(loc), r"^www\.", "")


def _any(c: Column, signs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(s) for s in signs))


def thin_reason(source: Column, visible: Column) -> Column:
    """anti-bot, cookies, login, script or empty: the first cause with a sign in the page's source or text."""
    head, text = F.lower(F.substring(source, 1, SOURCE_CHARS)), F.lower(visible)
    scripts = F.regexp_count(source, F.lit("(?i)<script[ >]")) >= MANY_SCRIPTS
    return (
        F.when(_any(head, BOT_SIGNS), "anti-bot").when(_any(head, COOKIE_SIGNS) | _any(text, COOKIE_SIGNS), "cookies").when(_any(head, LOGIN_SIGNS) | _any(text, LOGIN_SIGNS), "login")
        .when(_any(head, SCRIPT_SIGNS) | (scripts & source.rlike("(?i)<noscript[ >]")), "script").otherwise("")
    )


def content_class(chars: Column, thin: int = THIN_CHARS) -> Column:
    return F.when(F.coalesce(chars, F.lit(0)) == 0, "absent").when(chars < thin, "scarce").otherwise("complete")


def route(url: Column, content_type: Column, head: Column) -> Column:
    """binary, pdf, page or other: which engine a payload goes to. ``head`` is the start of the content."""
    suffix = F.regexp_extract(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"\.([a-z0-9]+)$", 1)
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(suffix.isin(BINARY_SUFFIXES), "binary").when((suffix == "pdf") | kind.contains("pdf") | head.startswith("%PDF"), "pdf").when((kind == "") | kind.rlike("html|xml|plain"), "page").otherwise("other")


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDDHHmmSS with an offset as ISO 8601; missing month and day are 01, without time a date; others unchanged."""
    s = F.trim(F.coalesce(c, F.lit("")))
    pattern = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(Z|[+-]\d{2}'?\d{2}'?)?"
    g = [F.regexp_extract(s, pattern, i) for i in range(8)]

    def part(i: int, default: str) -> Column:
        return F.when(g[i] == "", default).otherwise(g[i])

    day = F.concat_ws("-", g[1], part(2, "01"), part(3, "01"))
    zone = F.replace(g[7], F.lit("'"), F.lit(""))
    offset = F.when(g[7].isin("Z", ""), g[7]).otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
    iso = F.when(g[4] == "", day).otherwise(F.concat(day, F.lit("T"), F.concat_ws(":", g[4], part(5, "00"), part(6, "00")), offset))
    return F.when(g[1] == "", s).otherwise(iso)


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of rectangle a (x0, y0, x1, y1) that b covers; 0 where a has no area."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def needs_ocr(chars: Column, image_share: Column, mode: str = "auto") -> Column:
    """Whether a page is to be recognised: by mode, or by little native text under large images."""
    if mode in ("off", "ocrmypdf"):
        return F.lit(False)
    if mode == "tesseract":
        return F.lit(True)
    return F.coalesce((chars < 340) & (((chars < 100) & (image_share > 0.2)) | ((chars < 200) & (image_share > 0.3)) | (image_share > 0.95)), F.lit(False))
