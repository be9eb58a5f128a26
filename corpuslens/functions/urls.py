"""Column functions on addresses: canonical form, link resolution, scope, IP ranges, API paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, besides all that begin with utm_.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "ref", "source", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gl")
#: Those that links on a page lose.
LINK_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid")
_URL = r"^(?i)(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _parts(c: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.regexp_extract(c, _URL, i) for i in (1, 2, 3, 4))  # type: ignore[return-value]


def _host(scheme: Column, host: Column) -> Column:
    host = F.lower(host)
    return F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))


def _params(query: Column, tracking: tuple[str, ...], utm: bool) -> Column:
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    drop = lambda p: key(p).isin(*tracking) | (key(p).startswith("utm_") if utm else F.lit(False))
    return F.filter(F.array_remove(F.split(query, "&"), ""), lambda p: ~drop(p))


def canonical_url(c: Column) -> Column:
    """Source identity: lower scheme and host, no fragment or tracking parameters, others
    sorted by name, single slashes, none at the end. Anything but http(s) is only trimmed."""
    url = F.trim(F.coalesce(c, F.lit("")))
    scheme, host, path, query = _parts(url)
    scheme = F.lower(scheme)
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/$", "")
    by_name = F.array_sort(F.transform(_params(query, TRACKING, True), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    rest = F.array_join(F.transform(by_name, lambda s: F.when(F.contains(s["p"], F.lit("=")), s["p"]).otherwise(F.concat(s["p"], F.lit("=")))), "&")
    made = F.concat(scheme, F.lit("://"), _host(scheme, host), F.when(path == "", "/").otherwise(path), F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)))
    return F.when(url.rlike(_URL), made).otherwise(url)


def resolved_link(href: Column, base: Column) -> Column:
    """A link's address seen from a page; null for mail, script and fragment links."""
    href = F.trim(href)
    scheme, host, path, _ = _parts(base)
    origin = F.concat(F.lower(scheme), F.lit("://"), _host(F.lower(scheme), host))
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    full = (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.lower(scheme), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(origin, folder, F.regexp_replace(href, r"^(\./)+", "")))
    )
    s, h, p, q = _parts(full)
    rest = F.array_join(_params(q, LINK_TRACKING, False), "&")
    p = F.regexp_replace(F.when(p == "", "/").otherwise(p), "(?<=.)/$", "")
    made = F.concat(F.lower(s), F.lit("://"), _host(F.lower(s), h), p, F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)))
    return F.when(~href.rlike("(?i)^(#|mailto:|javascript:|tel:|data:)") & (href != ""), made)


def same_origin(a: Column, b: Column) -> Column:
    key = lambda c: F.lower(F.regexp_extract(c, r"^([A-Za-z]+://[^/?#]+)", 1))
    return key(a) == key(b)


#: Path words of pages that are no documentation.
IRRELEVANT = "pricing|login|signin|signup|register|careers|jobs|about|contact|legal|privacy|terms|blog|press|cart|checkout"
DOCS = "docs?|documentation|guides?|reference|api|learn|tutorials?|manual|handbook|help|developers?|sdk"


def skip_reason(url: Column, root: Column, depth: Column, max_depth: int = 3) -> Column:
    """Why a crawler leaves a link out, or null."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1))
    scope = F.regexp_extract(F.lower(F.regexp_extract(root, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)), r"^(/[^/]+)", 1)
    in_scope = path.startswith(scope) | path.rlike(rf"/(?:{DOCS})(?:/|$)")
    return (
        F.when(~same_origin(url, root), "external")
        .when(path.rlike(rf"/(?:{IRRELEVANT})(?:/|$)"), "irrelevant")
        .when(path.rlike(r"\.(?:png|jpe?g|gif|svg|css|js|ico|woff2?|zip|pdf|mp4)$"), "asset")
        .when(~in_scope, "out_of_scope")
        .when(depth > max_depth, "depth")
    )


def blocked_ip(ip: Column) -> Column:
    """Addresses that a fetcher must not reach: loopback, private, link-local, shared,
    test, multicast and reserved ranges of both families, and what is no address."""
    ip = F.lower(F.trim(F.coalesce(ip, F.lit(""))))
    v4 = F.regexp_extract(ip, r"^(?:::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    o = [F.try_element_at(F.split(v4, r"\."), F.lit(i + 1)).try_cast("int") for i in range(4)]
    bad4 = (
        o[0].isin(0, 10, 127) | (o[0] >= 224) | ((o[0] == 100) & o[1].between(64, 127)) | ((o[0] == 169) & (o[1] == 254)) | ((o[0] == 172) & o[1].between(16, 31))
        | ((o[0] == 192) & (o[1] == 168)) | ((o[0] == 192) & (o[1] == 0) & o[2].isin(0, 2)) | ((o[0] == 198) & o[1].isin(18, 19)) | ((o[0] == 198) & (o[1] == 51) & (o[2] == 100))
        | ((o[0] == 203) & (o[1] == 0) & (o[2] == 113)) | F.exists(F.array(*o), lambda x: x > 255)
    )
    bad6 = ip.rlike(r"^(::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|ff[0-9a-f]{2}:.*|2001:db8:.*)$")
    return F.when(v4 != "", bad4).when(F.contains(ip, F.lit(":")), bad6).otherwise(True)


def allowed_url(url: Column, ip: Column) -> Column:
    """http(s), no credentials, not localhost, and resolved to a public address."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return url.rlike("(?i)^https?://") & ~url.rlike(r"(?i)^https?://[^/?#]*@") & ~host.rlike(r"^(localhost|.*\.localhost|.*\.local|.*\.internal)$") & ~blocked_ip(ip)


def api_path(c: Column) -> Column:
    """Path of an address or path, without query."""
    return F.when(c.rlike("^https?://"), F.regexp_extract(c, r"^https?://[^/?#]*([^?#]*)", 1)).otherwise(F.trim(F.substring_index(c, "?", 1)))


def path_pattern(schema_path: Column) -> Column:
    """Anchored regular expression of a path template, any case."""
    plain = F.regexp_replace(api_path(schema_path), "/+$", "")
    plain = F.regexp_replace(plain, r"([.+*?^$()\[\]|\\])", r"\\$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\{[^}]+\}", "([^/]+)"), ":[a-zA-Z0-9_]+", "([^/]+)")
    return F.concat(F.lit("(?i)^"), plain, F.lit("$"))


def segment_count(path: Column) -> Column:
    return F.size(F.split(F.regexp_replace(api_path(path), "/+$", ""), "/"))
