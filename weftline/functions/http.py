"""Functions over responses and urls."""

from __future__ import annotations

import codecs
import re
from http import HTTPStatus
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.text import ColumnLike, col

# Fixed values.
BLOCKED_STATUSES = (401, 403, 407, 429, 444, 500, 502, 503, 504)
RESOURCE_TYPES = ("font", "image", "media", "beacon", "object", "imageset", "texttrack", "websocket", "csp_report", "stylesheet")
PROXY_ERRORS = ("net::err_proxy", "net::err_tunnel", "connection refused", "connection reset", "connection timed out", "failed to connect", "could not resolve proxy")
CHALLENGES = (("non-interactive", "cType: 'non-interactive'"), ("managed", "cType: 'managed'"), ("interactive", "cType: 'interactive'"), ("embedded", "challenges.cloudflare.com/turnstile/"))
UNKNOWN_STATUS = "Unknown Status Code"


def header(headers: ColumnLike, name: str) -> Column:
    """A header's value, whatever the letter case of its name."""
    return F.get(F.map_values(F.map_filter(col(headers), lambda k, v: F.lower(k) == name)), F.lit(0))


def media_type(headers: ColumnLike) -> Column:
    return F.lower(F.trim(F.substring_index(header(headers, "content-type"), ";", 1)))


def declared_encoding(headers: ColumnLike) -> Column:
    """``charset=`` of the content type, utf-8 without one."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(header(headers, "content-type"), r"charset=\s*[\"']?([^;\"']+)", 1)), F.lit("")), F.lit("utf-8"))


def status_text(status: ColumnLike) -> Column:
    """The standard phrase of a status code."""
    phrases = F.create_map(*[F.lit(x) for s in HTTPStatus for x in (int(s), s.phrase)])
    return F.coalesce(F.try_element_at(phrases, col(status).cast("int")), F.lit(UNKNOWN_STATUS))


def completed(responses: DataFrame) -> DataFrame:
    """Raw exchanges as responses: status 200, the standard reason, the declared encoding and GET where they are null."""
    status = F.coalesce("status", F.lit(200))
    return responses.withColumns(
        {
            "status": status,
            "reason": F.coalesce(F.nullif("reason", F.lit("")), status_text(status)),
            "encoding": F.coalesce("encoding", declared_encoding("headers")),
            "method": F.upper(F.coalesce("method", F.lit("GET"))),
        }
    )


def status_class(status: ColumnLike) -> Column:
    s = col(status)
    return F.when(s.between(200, 299), "success").when(s.between(300, 399), "redirect").when(s.between(400, 499), "client_error").when(s.between(500, 599), "server_error")


def is_success(status: ColumnLike) -> Column:
    return F.coalesce(col(status).between(200, 299), F.lit(False))


def is_blocked(status: ColumnLike) -> Column:
    return F.coalesce(col(status).isin(*BLOCKED_STATUSES), F.lit(False))


def is_proxy_error(message: ColumnLike) -> Column:
    return F.coalesce(F.lower(col(message)).rlike("|".join(map(re.escape, PROXY_ERRORS))), F.lit(False))


def challenge(page: ColumnLike) -> Column:
    """Kind of challenge page, as a label of data quality; null for none."""
    out = F.lit(None).cast("string")
    for kind, mark in reversed(CHALLENGES):
        out = F.when(F.contains(col(page), F.lit(mark)), kind).otherwise(out)
    return out


def host(url: ColumnLike) -> Column:
    """Host in lower case without user and port; empty where the url has none."""
    return F.lower(F.coalesce(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def url_path(url: ColumnLike) -> Column:
    """Path without query and fragment, ``/`` where it is empty."""
    path = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def without_fragment(url: ColumnLike) -> Column:
    return F.substring_index(col(url), "#", 1)


def store_scope(url: ColumnLike) -> Column:
    """The key a fingerprint store is scoped by: the host, ``default`` without a url, else the url in lower case."""
    h = host(url)
    return F.when(F.coalesce(col(url), F.lit("")) == "", "default").when(h != "", h).otherwise(F.lower(col(url)))


PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}


def join_url(base: str | None, relative: str | None) -> str | None:
    """``relative`` resolved against ``base``; unchanged without a valid base."""
    if relative is None or not base:
        return relative
    try:
        root = urlsplit(base)
        if not root.scheme or not root.netloc and root.scheme in PORTS:
            return relative
        parts = urlsplit(urljoin(base, relative.strip()))
        if not parts.netloc:
            return urlunsplit(parts)
        name = (parts.hostname or "").encode("idna").decode() if not (parts.hostname or "").isascii() else parts.hostname or ""
        port = f":{parts.port}" if parts.port and parts.port != PORTS.get(parts.scheme) else ""
        user = parts.netloc.rpartition("@")[0]
        path = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._[]|^\\")
        return urlunsplit((parts.scheme, f"{user}@{name}{port}" if user else name + port, path, quote(parts.query, safe="/?%:@!$&()*+,;=~-._[]|^\\{}`"), quote(parts.fragment, safe="/?%:@!$&'()*+,;=~-._[]|^\\{}#")))
    except ValueError:
        return relative


def url_join(base: ColumnLike, relative: ColumnLike) -> Column:
    @F.pandas_udf("string")
    def join(bases: pd.Series, relatives: pd.Series) -> pd.Series:
        return pd.Series([join_url(b, r) for b, r in zip(bases, relatives)], dtype=object)

    return join(col(base), col(relative))


def should_block_resource(kind: ColumnLike, enabled: bool = True) -> Column:
    return F.coalesce(col(kind).isin(*RESOURCE_TYPES), F.lit(False)) & F.lit(enabled)


def host_suffixes(name: ColumnLike) -> Column:
    """``a.b.c`` as ``[a.b.c, b.c, c]``."""
    parts = F.split(col(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


META_CHARSET = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?([^\s"';>]+)""", re.I)
#: Labels that stand for another encoding in the web's table of labels than in Python's.
WEB_LABELS = {
    **dict.fromkeys("ascii us-ascii ansi_x3.4-1968 iso-ir-100 csisolatin1 latin1 l1 iso8859-1 iso88591 iso-8859-1 iso_8859-1 iso_8859-1:1987 cp819 ibm819 cp1252 x-cp1252 windows-1252".split(), "windows-1252"),
    **dict.fromkeys("iso-8859-9 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 iso-ir-148 latin5 l5 csisolatin5 cp1254 x-cp1254 windows-1254".split(), "cp1254"),
    **dict.fromkeys("iso-8859-11 iso8859-11 iso885911 tis-620 dos-874 windows-874".split(), "cp874"),
    **dict.fromkeys("gb2312 gb_2312 gb_2312-80 csgb2312 chinese iso-ir-58 x-gbk csiso58gb231280 gbk".split(), "gbk"),
    **dict.fromkeys("shift_jis shift-jis sjis ms_kanji x-sjis csshiftjis windows-31j ms932".split(), "cp932"),
    **dict.fromkeys("euc-kr ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 korean cseuckr windows-949 iso-ir-149".split(), "cp949"),
    **dict.fromkeys("big5 big5-hkscs cn-big5 csbig5 x-x-big5".split(), "big5hkscs"),
    **dict.fromkeys("utf8 utf-8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8".split(), "utf-8"),
    **dict.fromkeys("unicode ucs-2 iso-10646-ucs-2 csunicode unicodefeff utf-16 utf-16le".split(), "utf-16-le"),
    **dict.fromkeys("unicodefffe utf-16be".split(), "utf-16-be"),
    **dict.fromkeys("iso-8859-8-i csiso88598i logical".split(), "iso8859-8"),
    **dict.fromkeys("dos-866 csibm866 866 cp866 ibm866".split(), "cp866"),
    **dict.fromkeys("koi koi8 koi8_r cskoi8r koi8-r".split(), "koi8-r"),
    **dict.fromkeys("koi8-ru koi8-u".split(), "koi8-u"),
    **dict.fromkeys("macintosh csmacintosh mac x-mac-roman".split(), "mac-roman"),
}
#: Python names that no web label stands for: such a label is unknown.
NOT_WEB = frozenset("utf-7 utf_7 utf7 idna punycode rot13 rot_13 base64 hex bz2 zip zlib uu quopri undefined unicode_escape raw_unicode_escape mbcs oem cp037 cp500 utf-32 utf_32 utf32".split())
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def web_codec(label: str | None) -> str:
    """The codec that a label means on the web; UTF-8 for unknown labels and null. ``iso-8859-1`` means windows-1252."""
    name = (label or "utf-8").strip(" \t\r\n\f").lower()
    if name in WEB_LABELS:
        return WEB_LABELS[name]
    try:
        return "utf-8" if name in NOT_WEB else codecs.lookup(name).name
    except (LookupError, ValueError):
        return "utf-8"


def _c1(error: UnicodeError) -> tuple[str, int]:
    """Bytes that a single-byte code page leaves undefined are read as C1 controls."""
    part = error.object[error.start : error.end]
    return "".join(chr(b) if 0x80 <= b < 0xA0 else "\ufffd" for b in part), error.end


codecs.register_error("weftline-c1", _c1)


def decode_bytes(body: bytes | None, encoding: str | None = None) -> str | None:
    """A page's bytes as text. A byte order mark decides, else the given label or the meta charset; UTF-8 for unknown labels."""
    if body is None:
        return None
    for mark, codec in MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(codec, "replace")
    if encoding is None:
        found = META_CHARSET.search(body)
        encoding = found[1].decode("latin-1") if found else "utf-8"
    codec = web_codec(encoding)
    return body.decode(codec, "weftline-c1" if codec in ("windows-1252", "cp1254", "cp874") else "replace")


def decode_html(body: ColumnLike, encoding: ColumnLike | None = None) -> Column:
    @F.pandas_udf("string")
    def decode(bodies: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([decode_bytes(b, e) for b, e in zip(bodies, labels)], dtype=object)

    return decode(col(body), col(encoding) if encoding is not None else F.lit(None).cast("string"))
