"""Scalar functions of the scan as Column expressions: snippets by bytes, entropy, URL resolution."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

AROUND, LONGEST = 20, 100


def _bytes(start: Column, length: Column, line: Column) -> Column:
    return F.substring(F.encode(line, "UTF-8"), start + 1, length)


def snippet_bytes(line: Column, token: Column) -> Column:
    """Up to 20 bytes on either side of the token's first occurrence, with dots where the line was cut.

    A token that the line lacks gives the line's first 100 bytes.
    """
    size, dots = F.octet_length(line), F.encode(F.lit("..."), "UTF-8")
    none = F.encode(F.lit(""), "UTF-8")
    at = F.octet_length(F.call_function("substring_index", line, token, F.lit(1)))
    start = F.greatest(at - AROUND, F.lit(0))
    end = F.least(at + F.octet_length(token) + AROUND, size)
    inside = F.concat(F.when(start > 0, dots).otherwise(none), _bytes(start, end - start, line), F.when(end < size, dots).otherwise(none))
    head = F.concat(_bytes(F.lit(0), F.lit(LONGEST), line), F.when(size > LONGEST, dots).otherwise(none))
    return F.when(F.contains(line, token), inside).otherwise(head)


def snippet(line: Column, token: Column) -> Column:
    """The snippet as text; a character that the cut broke becomes U+FFFD."""
    return F.make_valid_utf8(snippet_bytes(line, token).cast("string"))


def shannon_entropy(text: Column) -> Column:
    """In bits: counts of characters over the length in bytes; 0 for an empty text. Characters are taken in order, so the sum is definite."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    size = F.octet_length(text).cast("double")
    part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / size
    total = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - part(c) * F.log2(part(c)))
    return F.when(size == 0, F.lit(0.0)).otherwise(total)


def entropy_tokens(line: Column) -> Column:
    """Runs without blank, tab, quotes, comma and semicolon. A carriage return stays."""
    return F.filter(F.split(line, "[ \\t\"',;]+"), lambda t: t != "")


_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _URL, n)


def _without_dots(path: Column) -> Column:
    """Dot segments removed (RFC 3986, 5.2.4) from a path that starts with a slash."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segments, -1)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolve_url(base: Column, ref: Column) -> Column:
    """The reference against the base (RFC 3986); null if either can't be parsed (control characters, a stray percent sign
    in the path, or a colon in the first segment of a relative path)."""
    bad = lambda u: u.rlike(r"[\x00-\x1f\x7f]") | _part(u, 3).rlike(r"%(?![0-9a-fA-F]{2})")
    scheme, host, path, query, mark = (_part(ref, i) for i in range(1, 6))
    b_scheme, b_host, b_path, b_query = (_part(base, i) for i in range(1, 5))
    merged = F.when((b_host != "") & (b_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(b_path, r"(?s)^(.*/)?", 1), path))
    clean = lambda p: F.when(p.startswith("/"), _without_dots(p)).otherwise(p)
    with_scheme = F.concat(scheme, F.lit(":"), host, clean(path), query)
    with_host = F.concat(b_scheme, F.lit(":"), host, clean(path), query)
    rooted = F.concat(b_scheme, F.lit(":"), b_host, clean(path), query)
    relative = F.concat(b_scheme, F.lit(":"), b_host, clean(merged), query)
    same = F.concat(b_scheme, F.lit(":"), b_host, clean(b_path), F.when(query != "", query).otherwise(b_query))
    out = F.when(scheme != "", with_scheme).when(host != "", with_host).when(path.startswith("/"), rooted).when(path != "", relative).otherwise(same)
    colon = (scheme == "") & (host == "") & path.rlike("^[^/]*:")
    return F.when(~bad(base) & ~bad(ref) & ~colon, F.concat(out, mark))


#: Code points that a numeric reference to 128..159 stands for (Windows-1252).
_WINDOWS = {str(n): bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _code_point(number: Column) -> Column:
    """The character of a numeric reference; what is none becomes U+FFFD."""
    bad = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    windows = F.element_at(F.from_json(F.lit(json.dumps(_WINDOWS)), "map<string,string>"), number.cast("string"))
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(number).cast("long")), 8, "0")), "UTF-32")
    return F.when(bad, char).otherwise(F.coalesce(windows, char))


def unescape_attribute(value: Column) -> Column:
    """Character references of an attribute's value undone as HTML5 does: numeric ones, and named ones with a semicolon or,
    if neither a letter, a digit nor an equals sign follows, those of old names without one."""
    names = F.from_json(F.lit(json.dumps(dict(html.entities.html5))), "map<string,string>")

    def piece(p: Column) -> Column:
        number = F.regexp_extract(p, r"^(#[xX][0-9a-fA-F]+;?|#[0-9]+;?)", 1)
        digits = F.regexp_extract(number, r"([0-9a-fA-F]+)", 1)
        point = F.when(F.length(digits) > 9, F.lit(0)).when(number.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*;|[A-Za-z][A-Za-z0-9]*(?![=;A-Za-z0-9]))", 1)
        found = F.when(name != "", F.element_at(names, name))
        rest = lambda m: F.substring(p, F.length(m) + 1, F.length(p))
        return F.when(number != "", F.concat(_code_point(point), rest(number))).when(found.isNotNull(), F.concat(found, rest(name))).otherwise(F.concat(F.lit("&"), p))

    parts = F.split(value, "&")
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(F.contains(value, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))).otherwise(value)
