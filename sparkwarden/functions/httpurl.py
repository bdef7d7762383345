"""http and https URLs as a browser would write them: checked, and brought to one form, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.hosts import ascii_host, folded
from sparkwarden.functions.text import fresh

# What is percent-encoded in each part of a URL, besides what is not printable ASCII.
IN_FRAGMENT = r'[^\x21-\x7E]|["<>`]'
IN_QUERY = r"""[^\x21-\x7E]|["#<>']"""
IN_PATH = r'[^\x21-\x7E]|["<>`#?{}]'
IN_USER = r'[^\x21-\x7E]|["<>`#?{}/:;=@\[\\\]^|]'
FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
MOST_BYTES = 2083
PORTS = {"http": 80, "https": 443}
DOT, TWO_DOTS = (".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")


def percent(s: Column, what: str) -> Column:
    """s with the UTF-8 bytes of every character that matches `what` in percent form."""
    escaped = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.when(s.rlike(what), F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c.rlike(what), escaped(c)).otherwise(c)), "")).otherwise(s)


def resolved(path: Column) -> Column:
    """A path with its dot segments taken, each other segment encoded, and a slash in front."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    segments = F.split(F.substring(clean, 2, 1 << 30), "/")
    marked = F.transform(segments, lambda s, k: F.struct(s.alias("s"), (k == F.size(segments) - 1).alias("last")))
    ended = lambda t, last: F.when(last, F.concat(t, F.array(F.lit("")))).otherwise(t)

    def step(t: Column, x: Column) -> Column:
        low = F.lower(x["s"])
        up = F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))
        return F.when(low.isin(*TWO_DOTS), ended(up, x["last"])).when(low.isin(*DOT), ended(t, x["last"])).otherwise(F.concat(t, F.array(x["s"])))

    dotted = clean.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)")
    taken = F.when(dotted, F.aggregate(marked, F.array().cast("array<string>"), step)).otherwise(segments)
    return F.concat(F.lit("/"), percent(F.array_join(taken, "/"), IN_PATH))


def ipv4(host: Column) -> Column:
    """The dotted form of a host that ends in a number; null if it is no address. Parts may be decimal, octal (0...) or hexadecimal (0x...), and the last one may stand for several bytes."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    number = lambda p: F.when(p == "0x", "0").when(p.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(p, 3, 64), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]*)$"), p).try_cast("long")
    numbers = F.transform(parts, number)
    n = F.size(parts)
    last = F.try_element_at(numbers, F.lit(-1))
    fits = (n <= 4) & ~F.exists(numbers, lambda x: x.isNull()) & F.forall(F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), lambda x: x < 256) & (last < F.pow(F.lit(256.0), 5 - n))
    value = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), last, lambda t, k: t + F.when(k < n, F.try_element_at(numbers, k) * F.pow(F.lit(256.0), 4 - k).cast("long")).otherwise(0))
    octets = F.transform(F.array(*map(F.lit, (24, 16, 8, 0))), lambda k: F.call_function("shiftright", value, k).bitwiseAND(F.lit(255)).cast("string"))
    return F.when(fits, F.array_join(octets, "."))


def ipv6(host: Column) -> Column:
    """The shortest form of a bracketed address; null if it is none."""
    inner = F.lower(F.regexp_extract(host, r"^\[([0-9A-Fa-f:.]+)\]$", 1))
    byte = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    tail = rf"^(.*:){byte}\.{byte}\.{byte}\.{byte}$"
    b = [F.regexp_extract(inner, tail, k).try_cast("int") for k in range(2, 6)]
    plain = F.when(inner.contains("."), F.concat(F.regexp_extract(inner, tail, 1), F.lower(F.hex(b[0] * 256 + b[1])), F.lit(":"), F.lower(F.hex(b[2] * 256 + b[3])))).otherwise(inner)
    halves = F.split(plain, "::", -1)
    groups = lambda half: F.filter(F.split(half, ":", -1), lambda x: x != "")
    left, right = groups(F.get(halves, 0)), groups(F.coalesce(F.get(halves, 1), F.lit("")))
    known, cut = F.size(left) + F.size(right), F.size(halves) == 2
    whole = F.forall(halves, lambda h: (h == "") | h.rlike("^[0-9a-f]{1,4}(:[0-9a-f]{1,4})*$"))
    fits = whole & F.when(cut, known <= 7).otherwise((F.size(halves) == 1) & (known == 8))
    eight = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0))), right)
    text = F.concat(F.lit(":"), F.array_join(F.transform(eight, lambda x: F.lower(F.conv(x, 16, 16))), ":"), F.lit(":"))
    short = F.regexp_replace(text, "^:|:$", "")
    for n in range(2, 9):  # the last one that applies stands first
        run = rf"^(.*?):0(?::0){{{n - 1}}}:(.*)$"
        part = lambda k, r=run: F.regexp_extract(text, r, k)
        short = F.when(text.rlike(run), F.concat(F.regexp_replace(part(1), "^:", ""), F.lit("::"), F.regexp_replace(part(2), ":$", ""))).otherwise(short)
    return F.when(fits, F.concat(F.lit("["), short, F.lit("]")))


def normalised(df: DataFrame, url_col: str = "url", name: str = "http") -> DataFrame:
    """df with a struct `name`: url, in its one form, or null with the reason why it is none.

    As browsers do: blanks around and line breaks inside go; scheme and host in lower case; a host beyond ASCII in Punycode, percent-encoded hosts decoded; IPv4 in four decimal
    bytes, IPv6 in its shortest form; default and empty ports go; backslashes are slashes; dot segments are taken; an empty path is "/"; what a part can't hold is percent-encoded. Not
    looked at: which code points a registry allows, the order of several marks on a letter, and the length of labels. Reasons: missing, too long (over 2 083 bytes), no scheme, scheme (other than http and https),
    empty host, port, domain character, ipv4, ipv6.
    """
    p = fresh(df, "u")
    c = lambda k: F.col(f"{p}{k}")
    raw = F.col(url_col).cast("string")
    df = df.withColumn(f"{p}text", F.regexp_replace(F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", ""))
    df = df.withColumns({f"{p}scheme": F.lower(F.regexp_extract(c("text"), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)), f"{p}rest": F.regexp_replace(c("text"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*:[/\\]*", "")})
    df = df.withColumns({f"{p}authority": F.regexp_extract(c("rest"), r"^([^/\\?#]*)", 1), f"{p}after": F.regexp_replace(c("rest"), r"^[^/\\?#]*", "")})
    user, hostport = F.regexp_extract(c("authority"), r"(?s)^(.*)@", 1), F.regexp_replace(c("authority"), r"(?s)^.*@", "")
    df = df.withColumns({f"{p}user": user, f"{p}hostport": hostport, f"{p}path": F.regexp_extract(c("after"), r"^([^?#]*)", 1), f"{p}query": F.regexp_extract(c("after"), r"^[^?#]*(\?[^#]*)", 1), f"{p}fragment": F.regexp_extract(c("after"), r"(?s)^[^#]*(#.*)$", 1)})
    cut = r"(?s)^(\[[^\]]*\]|[^:\[][^:]*|)(?::(.*))?$"
    df = df.withColumns({f"{p}host": F.regexp_extract(c("hostport"), cut, 1), f"{p}port": F.regexp_extract(c("hostport"), cut, 2), f"{p}matched": c("hostport").rlike(cut)})
    decoded = F.try_url_decode(F.replace(c("host"), F.lit("+"), F.lit("%2B")))
    decoded = F.when(~decoded.contains("\ufffd"), decoded)  # bytes that are no text
    domain = F.when(decoded.rlike(r"[^\x00-\x7F]"), ascii_host(folded(decoded))).otherwise(F.lower(decoded))
    df = df.withColumn(f"{p}domain", F.when(c("host").startswith("["), ipv6(c("host"))).otherwise(domain))
    numeric = ~c("host").startswith("[") & c("domain").rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
    df = df.withColumn(f"{p}final", F.when(numeric, ipv4(c("domain"))).otherwise(c("domain")))
    port = F.regexp_replace(c("port"), "^0+(?=.)", "")
    reason = (
        F.when(raw.isNull(), "missing").when(F.octet_length(raw) > MOST_BYTES, "too long").when(c("scheme") == "", "no scheme").when(~c("scheme").isin(*PORTS), "scheme")
        .when((c("hostport") == "") | (c("matched") & (c("host") == "")), "empty host").when(c("matched") & ~(c("port").rlike("^[0-9]*$") & (F.coalesce(port.try_cast("int"), F.lit(-1)).between(0, 65535) | (port == ""))), "port")
        .when(c("hostport").startswith("[") & (c("final").isNull() | ~c("matched")), "ipv6").when(~c("host").startswith("[") & (c("domain").isNull() | c("domain").rlike(FORBIDDEN)), "domain character").when(c("domain") == "", "empty host").when(c("final").isNull(), "ipv4")
    )
    name_, word = F.regexp_extract(c("user"), r"(?s)^([^:]*)", 1), F.regexp_extract(c("user"), r"(?s)^[^:]*:(.*)$", 1)
    login = F.when((name_ == "") & (word == ""), "").otherwise(F.concat(percent(name_, IN_USER), F.when(word == "", "").otherwise(F.concat(F.lit(":"), percent(word, IN_USER))), F.lit("@")))
    usual = F.coalesce(port == F.get(F.array(*(F.lit(str(n)) for n in PORTS.values())), (c("scheme") == "https").cast("int")), F.lit(False))
    shown = F.concat(
        c("scheme"), F.lit("://"), login, c("final"), F.when((port == "") | usual, "").otherwise(F.concat(F.lit(":"), port)), resolved(c("path")),
        F.when(c("query") != "", F.concat(F.lit("?"), percent(F.substring(c("query"), 2, 1 << 30), IN_QUERY))).otherwise(""), F.when(c("fragment") != "", F.concat(F.lit("#"), percent(F.substring(c("fragment"), 2, 1 << 30), IN_FRAGMENT))).otherwise(""),
    )
    df = df.withColumn(f"{p}reason", reason)
    made = F.struct(F.when(c("reason").isNull(), shown).alias("url"), c("reason").alias("reason"))
    # A generator of one row: a filter on the result stays above it, instead of being written out again down to the scan.
    df = df.withColumn(name, F.explode(F.array(made)))
    return df.drop(*(f"{p}{k}" for k in ("text", "scheme", "rest", "authority", "after", "user", "hostport", "path", "query", "fragment", "host", "port", "matched", "domain", "final", "reason")))
