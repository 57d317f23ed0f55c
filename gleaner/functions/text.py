"""Column functions over text: slugs, urls, tokens, dates. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, besides those that begin with utm_.
TRACKING = ["fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "_ga", "_gl", "ref_src", "spm", "wickedid", "vero_id"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, make) -> Column:
    """make(value), with value computed once however often make uses it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def slugify(c) -> Column:
    """Letters and digits, each lower-cased by itself (no final form of sigma); whatever lies between them is one dash."""
    low = F.lower(F.replace(col(c), F.lit("Σ"), F.lit("σ")))
    return F.regexp_replace(F.regexp_replace(low, r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-|-$", "")


def normalize_req(c) -> Column:
    return F.lower(F.regexp_replace(col(c), r"\p{IsWhite_Space}+", ""))


def normalize_text(c) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(c), r"\p{IsWhite_Space}+", " ")))


def strip(c) -> Column:
    """Without any blanks of Unicode at both ends."""
    return F.regexp_replace(col(c), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def prefix_bytes(c: Column, n: Column) -> Column:
    """The shortest prefix of n bytes or more that cuts no character."""
    raw = F.encode(c, "UTF-8")
    cut = [F.try_validate_utf8(F.substring(raw, F.lit(1), (n + i).cast("int")).cast("string")) for i in range(4)]
    return F.coalesce(*cut, c)


def sha256(c) -> Column:
    return F.sha2(F.encode(col(c), "UTF-8"), 256)


#: What a path may hold as it is; all else is escaped. Names of one and two dots, escaped or not.
PATH_SAFE = r"[!$-;=@-_a-z|~&&[^\"<>`]]"
ONE_DOT, TWO_DOTS = [".", "%2e"], ["..", ".%2e", "%2e.", "%2e%2e"]

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*"
_AUTHORITY = _SCHEME + r"(?:([^/\\?#]*)@)?(\[[^\]/?#]*\]|[^/\\?#:]*)(:[0-9]*)?"


def _tidy(u: Column) -> Column:
    """Without blanks and control characters at the ends, and without tabs and line breaks."""
    return F.regexp_replace(u, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]+", "")


def url_host(u) -> Column:
    return F.lower(F.regexp_extract(_tidy(col(u)), _AUTHORITY, 3))


def url_path(u) -> Column:
    return F.regexp_extract(_tidy(col(u)), _AUTHORITY + r"([^?#]*)", 5)


def _escaped(path: Column) -> Column:
    """Characters that a path can't hold as percent escapes of their bytes."""
    runs = F.regexp_extract_all(path, F.lit(rf"(?s)({PATH_SAFE}+|.)"), F.lit(1))
    one = lambda x: F.when(x.rlike(rf"^{PATH_SAFE}"), x).otherwise(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))
    return F.when(path.rlike(rf"(?s)^{PATH_SAFE}*$"), path).otherwise(F.array_join(F.transform(runs, one), ""))


def _resolved(path: Column) -> Column:
    """Segments of one dot go, those of two take the one before with them; slashes at the end go."""

    def step(done, x):
        low = F.lower(x)
        return F.when(low.isin(ONE_DOT), done).when(low.isin(TWO_DOTS), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, x))

    folded = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    dots = path.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)")
    return F.regexp_replace(F.when(dots, folded).otherwise(path), "/+$", "")


# The numbers of Punycode (RFC 3492), its digits, dots of other scripts, and characters that a host ignores.
_BASE, _LOW, _HIGH, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_DOTS, _IGNORED = "\u3002\uff0e\uff61", r"[\u00ad\u200b\u2060\ufeff\ufe00-\ufe0f]"
# Steps that suffice for a host: digits of a number below 2 ** 31 (one of 26 at least after the first), halvings of a bias.
_NUMBER_STEPS, _BIAS_STEPS = 9, 8


def _number(q: Column, bias: Column) -> Column:
    """A number in digits of growing worth, the least first."""

    def step(s, k):
        t = F.greatest(F.lit(_LOW), F.least(F.lit(_HIGH), k - bias)).cast("long")
        more, rest, base = s["q"] >= t, s["q"] - t, F.lit(_BASE).cast("long") - t
        digit = F.when(more, t + rest % base).otherwise(s["q"])
        written = F.concat(s["out"], F.substring(F.lit(_DIGITS), (digit + 1).cast("int"), F.lit(1)))
        after = F.struct(F.when(more, F.floor(rest / base)).otherwise(0).cast("long").alias("q"), written.alias("out"), (~more).alias("done"))
        return F.when(s["done"], s).otherwise(after)

    start = F.struct(q.cast("long").alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    places = F.array(*(F.lit(_BASE * (j + 1)) for j in range(_NUMBER_STEPS)))
    return F.aggregate(places, start, step, lambda s: s["out"])


def _bias(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a number: it follows the numbers' size."""
    d = let(F.floor(delta / F.when(first, _DAMP).otherwise(2)).cast("long"), lambda x: x + F.floor(x / points).cast("long"))

    def step(s, _):
        large = s["d"] > (_BASE - _LOW) * _HIGH // 2
        return F.when(large, F.struct(F.floor(s["d"] / (_BASE - _LOW)).cast("long").alias("d"), (s["k"] + _BASE).alias("k"))).otherwise(s)

    start = F.struct(d.alias("d"), F.lit(0).cast("long").alias("k"))
    times = F.array(*(F.lit(j) for j in range(_BIAS_STEPS)))
    return F.aggregate(times, start, step, lambda s: s["k"] + F.floor(F.lit(_BASE) * s["d"] / (s["d"] + _SKEW)).cast("long"))


def punycode(label) -> Column:
    """A label in Punycode (RFC 3492), without xn--: its ASCII characters, then for each other one, ascending, how far
    code point and place lie from the last."""

    def made(chars):
        plain = F.filter(chars, lambda x: x["c"] < _FIRST)
        others = F.array_sort(F.filter(chars, lambda x: x["c"] >= _FIRST))

        def step(s, x):
            # of what is there already, how much stands before this one
            before = F.size(F.filter(chars, lambda y: (y["at"] < x["at"]) & (y["c"] <= x["c"]))).cast("long")
            put = F.struct(((x["c"] - s["n"]) * (s["h"] + 1) + before - s["i"]).alias("delta"), before.alias("before"))
            return let(put, lambda p: F.struct(
                x["c"].alias("n"), (p["before"] + 1).alias("i"), (s["h"] + 1).alias("h"), _bias(p["delta"], s["h"] + 1, s["first"]).alias("bias"), F.lit(False).alias("first"), F.concat(s["out"], _number(p["delta"], s["bias"])).alias("out"),
            ))

        zero = lambda n: F.lit(n).cast("long")
        start = F.struct(zero(_FIRST).alias("n"), zero(0).alias("i"), F.size(plain).cast("long").alias("h"), zero(_BIAS).alias("bias"), F.lit(True).alias("first"), F.lit("").alias("out"))
        head = F.array_join(F.transform(plain, lambda x: F.char(x["c"])), "")
        return F.concat(head, F.when(F.size(plain) > 0, "-").otherwise(""), F.aggregate(others, start, step, lambda s: s["out"]))

    chars = F.transform(F.regexp_extract_all(col(label), F.lit("(?s)."), F.lit(0)), lambda x, i: F.struct(F.ascii(x).cast("long").alias("c"), i.cast("long").alias("at")))
    return let(chars, made)


def ascii_host(host) -> Column:
    """A host in lower case, and in ASCII if it has other letters: mapped as UTS 46 does without its transitional forms
    (case, width, dots of other scripts, ignored characters), each label in Punycode. Marks that combine with the letter
    before them aren't composed."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in _DOTS)
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    mapped = F.regexp_replace(F.lower(F.translate(col(host), wide + _DOTS + "Σ", narrow + "..." + "σ")), _IGNORED, "")
    labels = F.transform(F.split(mapped, r"\."), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x))
    return F.when(col(host).rlike(r"[^\x00-\x7F]"), F.array_join(labels, ".")).otherwise(F.lower(col(host)))


def canonical_url(u) -> Column:
    """Without fragment, tracking parameters and trailing slashes; dots resolved, the path escaped, other parameters sorted
    and encoded anew. Hosts are in lower case and in ASCII."""

    def made(u):
        scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
        port = F.regexp_extract(u, _AUTHORITY, 4)
        port = F.when(port.isin("", ":") | (scheme == "http") & (port == ":80") | (scheme == "https") & (port == ":443"), "").otherwise(port)
        user = F.regexp_extract(u, _AUTHORITY, 2)
        # a percent sign that begins no escape is itself
        decode = lambda x: F.coalesce(F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")), x)
        pairs = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
        # the name ends at the first =, the value may hold more of them
        parted = F.transform(pairs, lambda x: F.struct(decode(F.regexp_extract(x, "^[^=]*", 0)).alias("k"), decode(F.regexp_extract(x, "^[^=]*=?(.*)$", 1)).alias("v")))
        kept = F.array_sort(F.filter(parted, lambda p: ~p["k"].startswith("utm_") & ~p["k"].isin(TRACKING)))
        query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
        path = let(F.translate(F.regexp_extract(u, _AUTHORITY + r"([^?#]*)", 5), "\\", "/"), lambda p: _escaped(_resolved(p)))
        end = let(path, lambda p: F.when(p == "", "/").otherwise(p))
        # a user without a name or a password leaves no trace
        at = F.when(user.isin("", ":"), "").otherwise(F.concat(F.regexp_replace(user, ":$", ""), F.lit("@")))
        return F.concat(scheme, F.lit("://"), at, let(F.regexp_extract(u, _AUTHORITY, 3), ascii_host), port, end, let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))

    return F.when(col(u).isNotNull(), let(_tidy(col(u)), made))


def token_in(token: str, c) -> Column:
    """The token stands in the text between ends or characters that aren't ASCII letters or digits."""
    if not token:
        return F.lit(False)
    return col(c).rlike(r"(?iu)(?:^|[^A-Za-z0-9])" + java_quote(token) + r"(?:$|[^A-Za-z0-9])")


def java_quote(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s, flags=re.ASCII) if s.isascii() else "\\Q" + s + "\\E"


def company_from_title(c) -> Column:
    """What follows the last dash or ` at `, up to a comma, dot or bar; two bytes and a letter at least."""
    c, out = col(c), []
    for sep in (" — ", " – ", " at "):
        tail = F.trim(F.regexp_extract(F.substring_index(c, sep, -1), r"^[^,.|]*", 0))
        out.append(F.when(c.contains(sep) & (F.octet_length(tail) >= 2) & tail.rlike(r"\p{IsAlphabetic}"), tail))
    return F.coalesce(*out)


def prettify_slug(c) -> Column:
    words = F.filter(F.split(col(c), "[-_]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def thousands(c) -> Column:
    return F.format_number(col(c), 0)


def sanitize(c) -> Column:
    return F.regexp_replace(col(c), r"\p{Cc}", "")


def weight_text(w: Column) -> Column:
    """Three decimals, ties to even, zeros at the end cut."""
    return F.regexp_replace(F.bround(w.cast("decimal(20,10)"), 3).cast("string"), r"\.?0+$", "")


def occurred_at(c) -> Column:
    """An RFC 3339 time, or a date, which means noon UTC; anything else raises."""
    c = col(c)
    noon = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_timestamp(F.concat(c, F.lit("T12:00:00Z")), "yyyy-MM-dd'T'HH:mm:ssX"))
    return F.when(c.isNotNull(), F.coalesce(noon, F.try_to_timestamp(c), F.raise_error(F.concat(F.lit("not a time: "), c)).cast("timestamp")))


def watermark(c) -> Column:
    """A source's time in UTC to the second; what can't be read stays as it is."""
    c = col(c)
    return F.coalesce(F.date_format(F.try_to_timestamp(F.trim(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'"), c)
