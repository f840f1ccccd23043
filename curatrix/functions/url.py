"""URL expressions: safety, canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = "(?i)^(utm_.*|ref|referrer|source|gclid|fbclid)$"
ADDRESS = "^(?i)(https?):[/\\\\]{2}([^/\\\\?#\\s]+)([^?#]*)(\\?[^#]*)?(#.*)?$"
#: What a path may hold as it is; all else is percent-encoded.
PLAIN = "[!$-;=@-\\]_a-z|~]"
DOTS = "(?i)(^|/)(\\.|%2e){1,2}(/|$)"
#: A percent sign that begins no byte.
LONE_PERCENT = "%(?![0-9A-Fa-f]{2})"


def is_safe_url(url: Column) -> Column:
    """An absolute http or https address."""
    return F.coalesce(url.rlike("^(?i)https?://[^/?#\\s]+"), F.lit(False))


def without_dots(path: Column) -> Column:
    """An absolute path without the segments . and .. (also percent-encoded); .. at the root has nothing to take away."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    marked = F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i == F.size(parts) - 1).alias("last"), F.regexp_replace(s, "(?i)%2e", ".").alias("dots")))
    end = lambda x: F.when(x["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x["dots"] == "..", F.concat(up, end(x))).when(x["dots"] == ".", F.concat(done, end(x))).otherwise(F.concat(done, F.array(x["s"])))

    reduced = F.concat(F.lit("/"), F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(DOTS), reduced).otherwise(path)


def encoded_path(path: Column) -> Column:
    """Characters outside PLAIN as the percent-encoded bytes of their UTF-8; what is encoded already stays as it is."""
    one = lambda c: F.when(c.rlike(PLAIN), c).when(c == " ", F.lit("%20")).otherwise(F.url_encode(c))
    marks = F.array_join(F.transform(F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0)), one), "")
    return F.when(path.rlike(PLAIN.replace("[", "[^", 1)), marks).otherwise(path)


def normal_query(query: Column) -> Column:
    """Parameters in the order of their keys (of one key: as they came), without those that track, each decoded and encoded
    as a form does it. The order is that of the Unicode collation."""
    decoded = lambda s: F.url_decode(F.regexp_replace(s, LONE_PERCENT, "%25"))
    value = lambda p: F.when(F.instr(p, "=") > 0, p.substr(F.instr(p, "=") + 1, F.length(p))).otherwise("")
    given = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(given, lambda p, i: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), decoded(value(p)).alias("v")))
    kept = F.filter(pairs, lambda x: ~x["k"].rlike(TRACKING))
    order = F.array_sort(F.transform(kept, lambda x: F.struct(F.collate(x["k"], "UNICODE").alias("o"), x["i"].alias("i"), x["k"].alias("k"), x["v"].alias("v"))))
    return F.array_join(F.transform(order, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """The normal form of an http(s) address; anything else is only trimmed, and null is the empty text.

    Lower-case scheme and host (letters beyond ASCII by IDNA 2003), no default or empty port, no fragment, no dot segments;
    the path percent-encoded where it must be; the query by `normal_query`; no trailing slash where the address ends with
    the path, but at the root. Tabs and line ends count as not there. User info keeps its case. A port over 65535 or a host that
    IDNA refuses makes it no address.
    """
    t = F.trim(F.coalesce(url, F.lit("")))
    line = F.regexp_replace(t, "[\\t\\n\\r]", "")
    piece = lambda i: F.regexp_extract(line, ADDRESS, i)
    scheme = F.lower(piece(1))
    user = F.regexp_extract(piece(2), "^(.*@)", 1)  # its case counts
    place = F.regexp_extract(piece(2), "([^@]*)$", 1)
    name = F.lower(F.regexp_replace(place, ":[0-9]*$", ""))
    host = F.when(name.rlike("^[\\x00-\\x7f]*$"), name).otherwise(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name)))
    digits = F.regexp_extract(place, ":([0-9]*)$", 1)
    number = digits.try_cast("int")
    port = F.when(number.isNull() | (number == F.when(scheme == "https", 443).otherwise(80)), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
    path = encoded_path(without_dots(F.when(piece(3) == "", "/").otherwise(F.translate(piece(3), "\\", "/"))))
    query = normal_query(F.substring(piece(4), 2, 1 << 30))
    path = F.when((F.length(path) > 1) & (query == ""), F.regexp_replace(path, "/$", "")).otherwise(path)
    canonical = F.concat(scheme, F.lit("://"), user, host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    good = line.rlike(ADDRESS) & ((digits == "") | F.coalesce(number <= 65535, F.lit(False))) & (name != "") & ~name.rlike("^[^\\[].*:")
    return F.when(good, F.coalesce(canonical, t)).otherwise(t)
