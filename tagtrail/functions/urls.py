"""URL parsing as regex Column expressions.

``parse_url`` is not used: it raises on URLs with spaces or ``|`` and keeps
``;params`` in the path, whereas the semantics wanted here are those of
Python's ``urlparse`` (netloc with port / userinfo, params split off the last
path segment)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

_SCHEME_NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH_AFTER_NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_PATH_NO_SCHEME = r"^([^?#]*)"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def netloc(url: str | Column) -> Column:
    """Network location ('' when the URL has no scheme://)."""
    return F.regexp_extract(_c(url), _SCHEME_NETLOC, 1)


def path(url: str | Column) -> Column:
    """Path without query, fragment and ';params' of the last segment."""
    u = _c(url)
    raw = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_extract(u, _PATH_AFTER_NETLOC, 1)).otherwise(
        F.regexp_extract(u, _PATH_NO_SCHEME, 1)
    )
    return F.regexp_replace(raw, r";[^/]*$", "")


def anchored(pattern: str) -> str:
    """Start-anchored form of a pattern (Python ``re.match`` semantics)."""
    return "^(?:" + pattern + ")"


def item_id(url_path: str | Column) -> Column:
    """Numeric id of an item page path, NULL when the path is no item page."""
    return F.regexp_extract(_c(url_path), "^" + C.ITEM_PATH, 1).try_cast("bigint")


def url_pid(url: str | Column) -> Column:
    """Product id found anywhere in a URL (unanchored)."""
    return F.regexp_extract(_c(url), C.URL_PID, 1).try_cast("bigint")


def item_type(url_path: str | Column) -> Column:
    """P5: 'cheap' when the path is a cheap item page, else 'favorable'."""
    return F.when(_c(url_path).rlike("^" + C.ITEM_CHEAP), "cheap").otherwise("favorable")


def referrer_main_cat(url_referrer: str | Column) -> Column:
    """Main category of the listing page that referred the load."""
    return F.nullif(F.regexp_extract(_c(url_referrer), C.REFERRER_CATEGORY, 1), F.lit("")).cast("bigint")


def referrer_sub_cat(url_referrer: str | Column) -> Column:
    """Optional sub category (third group) of the referring listing page."""
    return F.nullif(F.regexp_extract(_c(url_referrer), C.REFERRER_CATEGORY, 3), F.lit("")).cast("bigint")


def page_family_pattern(families: dict[str, str] | None = None) -> str:
    """one start-anchored alternation of all page families (one regex pass)."""
    fam = C.PAGE_FAMILIES if families is None else families
    return "^(?:" + "|".join(fam.values()) + ")"


def page_family(url_path: str | Column, families: dict[str, str] | None = None) -> Column:
    """name of the first family whose pattern matches, NULL if none."""
    fam = C.PAGE_FAMILIES if families is None else families
    p = _c(url_path)
    return F.coalesce(*[F.when(p.rlike(anchored(pat)), F.lit(name)) for name, pat in fam.items()])
