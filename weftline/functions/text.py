"""Text, attribute, cookie and header functions as Column expressions.

Each takes a Column or a column's name and stays in the JVM, but for regular
expressions of several groups and ``parse_curl``, which need Python and run on Arrow batches.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- cleaning --------------------------------------------------------------------


def unescape(x: ColumnLike) -> Column:
    """Character references resolved; texts without ``&`` never leave the JVM's batch unchanged."""

    @F.pandas_udf("string")
    def resolve(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)

    return resolve(col(x))


def trim_text(x: ColumnLike) -> Column:
    """Unicode white space off both ends."""
    return trim_end_text(trim_start_text(x))


def trim_start_text(x: ColumnLike) -> Column:
    return F.regexp_replace(col(x), r"(?U)^\s+", "")


def trim_end_text(x: ColumnLike) -> Column:
    return F.regexp_replace(col(x), r"(?U)\s+$", "")


def clean_whitespace(x: ColumnLike) -> Column:
    """Tab, CR and LF to a space, runs of spaces to one; not trimmed."""
    return F.regexp_replace(F.translate(col(x), "\t\r\n", "   "), " +", " ")


def clean_spaces(x: ColumnLike) -> Column:
    """Tab to a space, CR and LF deleted, runs of spaces to one; not trimmed."""
    return F.regexp_replace(F.translate(col(x), "\t\r\n", " "), " +", " ")


def clean(x: ColumnLike, entities: bool = False) -> Column:
    """``clean_whitespace``, trimmed; references resolved first if asked."""
    return trim_text(clean_whitespace(unescape(x) if entities else x))


def replace_text(x: ColumnLike, old: str, new: str) -> Column:
    return F.replace(col(x), F.lit(old), F.lit(new))


def split_text(x: ColumnLike, separator: str) -> Column:
    """Literal split; a null text gives null."""
    return F.split(col(x), java_quote(separator), -1)


def sort_chars(x: ColumnLike, reverse: bool = False) -> Column:
    """The characters in code point order."""
    chars = F.filter(F.split(col(x), ""), lambda c: c != "")
    return F.array_join(F.sort_array(chars, asc=not reverse), "")


def upper_text(x: ColumnLike) -> Column:
    return F.upper(col(x))


def lower_text(x: ColumnLike) -> Column:
    return F.lower(col(x))


def java_quote(literal: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


# --- regular expressions ---------------------------------------------------------


class PatternError(ValueError):
    """An invalid pattern, or one with look-around or back-references, which the dialect lacks."""


def java_pattern(pattern: str, case_sensitive: bool = True) -> str:
    """A pattern with Unicode classes for the JVM. Raises ``PatternError``."""
    check_pattern(pattern)
    return ("(?U)" if case_sensitive else "(?iuU)") + pattern


def check_pattern(pattern: str) -> re.Pattern:
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise PatternError(f"look-around and back-references are not supported: {pattern!r}")
    try:
        return re.compile(pattern)
    except re.error as e:
        raise PatternError(f"invalid pattern {pattern!r}: {e}") from None


def re_all(x: ColumnLike, pattern: str, entities: bool = False, clean_match: bool = False, case_sensitive: bool = True) -> Column:
    """All matches. With groups: every group that took part, of every match, in order. Null gives an empty array."""
    compiled = check_pattern(pattern)
    text = clean(x) if clean_match else col(x)
    if compiled.groups <= 1 and not entities and "?" not in pattern.replace("(?:", "") and "|" not in pattern and "*" not in pattern:
        found = F.regexp_extract_all(text, F.lit(java_pattern(pattern, case_sensitive)), F.lit(compiled.groups))
        return F.coalesce(found, F.array().cast("array<string>"))
    flags = 0 if case_sensitive else re.IGNORECASE

    @F.pandas_udf("array<string>")
    def extract(texts: pd.Series) -> pd.Series:
        search = re.compile(pattern, flags)

        def one(t: str | None) -> list[str]:
            if t is None:
                return []
            out = [g for m in search.finditer(t) for g in (m.groups() if search.groups else (m[0],)) if g is not None]
            return [html.unescape(g) for g in out] if entities else out

        return texts.map(one)

    return extract(text)


def re_matches(x: ColumnLike, pattern: str, case_sensitive: bool = True) -> Column:
    """Whether the pattern is found; null is no match."""
    return F.coalesce(col(x).rlike(java_pattern(pattern, case_sensitive)), F.lit(False))


def re_first(x: ColumnLike, pattern: str, default: str | None = None, **options) -> Column:
    return F.coalesce(F.get(re_all(x, pattern, **options), F.lit(0)), F.lit(default))


# --- lists of texts --------------------------------------------------------------


def list_re(x: ColumnLike, pattern: str) -> Column:
    """All matches in all elements of an array; patterns of one group at most."""
    groups = check_pattern(pattern).groups
    return F.flatten(F.transform(col(x), lambda t: F.coalesce(F.regexp_extract_all(t, F.lit(java_pattern(pattern)), F.lit(groups)), F.array().cast("array<string>"))))


def list_re_first(x: ColumnLike, pattern: str, default: str | None = None) -> Column:
    return F.coalesce(F.get(list_re(x, pattern), F.lit(0)), F.lit(default))


def list_first(x: ColumnLike) -> Column:
    return F.get(col(x), F.lit(0))


def list_display(x: ColumnLike) -> Column:
    """``["a", "b"]``, without escapes."""
    return F.concat(F.lit("["), F.array_join(F.transform(col(x), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]"))


def flatten(x: ColumnLike) -> Column:
    return F.flatten(col(x))


# --- JSON and attribute maps -----------------------------------------------------


def json_text(x: ColumnLike, path: str) -> Column:
    return F.get_json_object(col(x), path)


def json_value(x: ColumnLike, schema: str) -> Column:
    return F.from_json(col(x), schema)


def attr_get(attrs: ColumnLike, name: str) -> Column:
    """Null where the attribute is missing."""
    return F.try_element_at(col(attrs), F.lit(name))


def attr_contains(attrs: ColumnLike, name: str) -> Column:
    return F.map_contains_key(col(attrs), name)


def attr_len(attrs: ColumnLike) -> Column:
    return F.cardinality(col(attrs))


def attr_names(attrs: ColumnLike) -> Column:
    """Sorted, as maps have no order."""
    return F.array_sort(F.map_keys(col(attrs)))


def attr_values(attrs: ColumnLike) -> Column:
    """In the order of the names."""
    return F.transform(sorted_entries(attrs), lambda e: e["value"])


def sorted_entries(attrs: ColumnLike) -> Column:
    return F.array_sort(F.map_entries(col(attrs)))


def attr_search_values(attrs: ColumnLike, keyword: str, partial: bool = False) -> Column:
    """Single-entry maps of the attributes whose value equals, or contains, the keyword."""
    hit = (lambda e: F.contains(e["value"], F.lit(keyword))) if partial else (lambda e: e["value"] == keyword)
    return F.transform(F.filter(sorted_entries(attrs), hit), lambda e: F.create_map(e["key"], e["value"]))


def attr_json(attrs: ColumnLike) -> Column:
    """A JSON object with sorted names."""
    return F.to_json(F.map_from_entries(sorted_entries(attrs)))


# --- cookies, headers, commands --------------------------------------------------


def parse_cookies(x: ColumnLike) -> Column:
    """``a=1; b`` as an array of ``struct<name, value>``, order kept; no ``=`` means an empty value."""
    parts = F.filter(F.transform(F.split(col(x), ";"), lambda p: trim_text(p)), lambda p: p != "")

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        name = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(trim_text(name).alias("name"), trim_text(value).alias("value"))

    return F.transform(parts, pair)


def parse_header_lines(lines: ColumnLike) -> Column:
    """``Name: value`` lines as a map; lines without a colon fall away, the last of equal names wins."""
    def entry(line: Column) -> Column:
        at = F.instr(line, ":")
        return F.struct(trim_text(F.substring(line, F.lit(1), at - 1)).alias("key"), trim_text(F.substring(line, at + 1, F.length(line))).alias("value"))

    whole = F.transform(col(lines), lambda s: F.regexp_replace(s, r";+\s*$", ""))
    entries = F.transform(F.filter(whole, lambda s: F.contains(s, F.lit(":"))), entry)
    # keep the last of equal names
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def parse_pairs(pairs: ColumnLike, delimiter: str = "=") -> Column:
    """``name<delimiter>value`` texts of an array as a map; those without the delimiter fall away, the last of equal names wins."""
    def entry(p: Column) -> Column:
        at = F.instr(p, delimiter)
        return F.struct(trim_text(F.substring(p, F.lit(1), at - 1)).alias("key"), trim_text(F.substring(p, at + len(delimiter), F.length(p))).alias("value"))

    entries = F.transform(F.filter(col(pairs), lambda p: F.contains(p, F.lit(delimiter))), entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def display(x: ColumnLike, size: int = 40) -> Column:
    """A short form for logs: white space cleaned, cut to ``size`` bytes, with dots if it was cut."""
    text = clean(x)
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, size).cast("string"))
    return F.when(F.octet_length(text) > size, F.concat(F.rtrim(F.replace(cut, F.lit("\ufffd"), F.lit(""))), F.lit("..."))).otherwise(text)


CURL = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("cookies", T.MapType(T.StringType(), T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("json_data", T.StringType()),
        T.StructField("proxy", T.StringType()),
        T.StructField("follow_redirects", T.BooleanType()),
    ]
)


class CommandError(ValueError):
    """A command that can't be read."""


def shell_split(command: str) -> list[str]:
    """Words of a shell command: quotes, backslashes and continued lines. Empty words fall away."""
    words, word, quote, i = [], "", "", 0
    while i < len(command):
        c = command[i]
        if quote == "'":
            quote, word = ("", word) if c == "'" else (quote, word + c)
        elif c == "\\" and i + 1 < len(command):
            i += 1
            word += "" if command[i] == "\n" else command[i]
        elif quote:
            quote, word = ("", word) if c == quote else (quote, word + c)
        elif c in "'\"":
            quote = c
        elif c.isspace():
            words, word = words + [word] * bool(word), ""
        else:
            word += c
        i += 1
    if quote:
        raise CommandError("unterminated quote")
    return words + [word] * bool(word)


def _put_method(out: dict, value: str) -> None:
    out["method"], out["explicit"] = value.upper(), True


def _put_cookies(out: dict, value: str) -> None:
    for part in value.split(";"):
        name, _, content = part.strip().partition("=")
        if name:
            out["cookies"][name.strip()] = content.strip()


def _put_header(out: dict, value: str) -> None:
    name, colon, content = value.partition(":")
    if colon and name.strip().lower() == "cookie":
        _put_cookies(out, content)
    elif colon:
        out["headers"][name.strip()] = content.strip()


def _parsed_json(value: str) -> object:
    try:
        return json.loads(value, parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))
    except (ValueError, RecursionError) as e:
        raise CommandError("not JSON") from e


def _put_json(out: dict, value: str) -> None:
    out["json_data"] = json.dumps(_parsed_json(value), separators=(",", ":"), ensure_ascii=False)
    out["headers"].setdefault("Content-Type", "application/json")
    out["method"] = out["method"] if out["explicit"] else "POST"


def _put_data(out: dict, value: str) -> None:
    try:
        parsed = _parsed_json(value)
    except CommandError:
        parsed = None
    if isinstance(parsed, dict | list):
        out["json_data"] = json.dumps(parsed, separators=(",", ":"), ensure_ascii=False)
    else:
        out["data"] = value
    out["method"] = out["method"] if out["explicit"] else "POST"


def _put_proxy(out: dict, value: str) -> None:
    out["proxy"] = value


#: The options with a value, and what each does.
CURL_OPTIONS = {
    **dict.fromkeys(("-X", "--request"), _put_method), **dict.fromkeys(("-H", "--header"), _put_header), **dict.fromkeys(("-b", "--cookie"), _put_cookies),
    **dict.fromkeys(("-d", "--data", "--data-raw", "--data-binary", "--data-urlencode"), _put_data), "--json": _put_json, **dict.fromkeys(("-x", "--proxy"), _put_proxy),
}
WEB = ("http://", "https://")


def parse_curl_command(command: str) -> dict:
    """One curl command as a dictionary of the fields of ``CURL``. Raises ``CommandError``.

    The last word that is a web address is the url, else the first word that is no option.
    An option without its value, ``--json`` of no JSON and a command without url are errors.
    """
    out = {"method": "GET", "url": "", "headers": {}, "cookies": {}, "data": None, "json_data": None, "proxy": None, "follow_redirects": False, "explicit": False}
    words = shell_split(command)
    todo = words if words[:1] and words[0].startswith(WEB) else words[1:]
    while todo:
        word, todo = todo[0], todo[1:]
        if word in CURL_OPTIONS:
            if not todo:
                raise CommandError(f"{word} needs a value")
            CURL_OPTIONS[word](out, todo[0])
            todo = todo[1:]
        elif word in ("-L", "--location"):
            out["follow_redirects"] = True
        elif word.startswith(WEB) or not word.startswith("-") and not out["url"]:
            out["url"] = word
    if not out["url"]:
        raise CommandError("no url")
    del out["explicit"]
    return out


def parse_curl(x: ColumnLike) -> Column:
    """A curl command as a struct; null for null and for commands that can't be read."""

    @F.pandas_udf(CURL)
    def parse(commands: pd.Series) -> pd.DataFrame:
        def one(c: str | None) -> list:
            try:
                found = parse_curl_command(c) if c is not None else {}
            except CommandError:
                found = {}
            return [found.get(name) for name in CURL.names]

        return pd.DataFrame([one(c) for c in commands], columns=CURL.names, dtype=object)

    parsed = parse(col(x))
    return F.when(parsed["url"].isNotNull(), parsed)
