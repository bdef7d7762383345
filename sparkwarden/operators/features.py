"""The 79 URL features as one projection over the parsed URL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.characters import count_of
from sparkwarden.functions.text import distinct_grams, entropy, flag, has, occurrences, runs, tokens
from sparkwarden.functions.url import SUFFIXES, parsed

# Fixed values.
SECURITY_TERMS = ("secure", "account", "webscr", "login", "ebayisapi", "sign", "banking", "confirm")
TERMS = ("secure", "account", "update", "login", "verify", "password", "confirm")
BRANDS = ("paypal", "apple", "amazon", "microsoft", "google", "facebook", "netflix", "bank")
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "is.gd", "cli.gs", "ow.ly", "buff.ly", "adf.ly", "tiny.cc", "lnkd.in", "db.tt", "qr.ae", "cutt.ly")
RISKY_SUFFIXES = ("tk", "ml", "ga", "cf", "gq", "xyz")
EXTENSIONS = r"\.(php|exe|js|cgi|pl|sh|py|asp|aspx|dll)"
COUNTED = {"dots": ".", "hyphens": "-", "underscores": "_", "slashes": "/", "questionmarks": "?", "equals": "=", "ats": "@", "ampersands": "&", "exclamations": "!", "spaces": " "}


def staged(df: DataFrame, u: str = "u") -> DataFrame:
    """df with what several features share, worked out once a row; columns that no feature asks for are pruned."""
    s, d, p, q = (F.col(f"{u}.{k}") for k in ("url", "domain", "path", "query"))
    df = df.withColumns({"_low": F.lower(s), "_host": F.lower(d), "_runs": runs(s), "_parts": tokens(d, "[.-]"), "_dirs": tokens(p, "/"), "_domain_entropy": entropy(d), "_path_entropy": entropy(p), "_query_entropy": entropy(q)})
    df = df.withColumns({"_entropy": entropy(s, F.col("_runs")), "_lower_parts": F.transform("_parts", F.lower)})
    nearest = lambda b: F.array_min(F.transform("_lower_parts", lambda t: F.levenshtein(F.lit(b), t)))
    return df.withColumns({f"_{b}": F.coalesce(nearest(b), F.lit(-1)) for b in BRANDS})


@cache
def expressions(u: str = "u") -> dict[str, Column]:
    """All features by name, in their frozen order, over a frame as functions.url.parsed and then staged give; built once a process."""
    s, d, p, q, f = (F.col(f"{u}.{k}") for k in ("url", "domain", "path", "query", "fragment"))
    sub, reg, suf, low, host = F.col(f"{u}.subdomain"), F.col(f"{u}.registered"), F.col(f"{u}.suffix"), F.col("_low"), F.col("_host")
    n = F.greatest(F.length(s), F.lit(1))
    share = lambda pattern, text=s: F.regexp_count(text, F.lit(pattern)) / n
    parts, dirs = F.col("_parts"), F.col("_dirs")
    out = {"url_length": F.length(s), "domain_length": F.length(d), "path_length": F.length(p)}
    out |= {f"count_{k}": occurrences(s, c) for k, c in COUNTED.items()}
    out |= {"count_www": occurrences(low, "www"), "count_com": occurrences(low, ".com")}
    out |= {"digit_count": count_of(s, "digit"), "letter_count": count_of(s, "alpha")}
    out["digit_letter_ratio"] = out["digit_count"] / (out["letter_count"] + 1)
    out["has_ip_address"] = flag(d.rlike(r"^\d{1,3}(\.\d{1,3}){3}(:[0-9]+)?$"))
    out["has_port"] = has(d, ":")
    out["subdomain_count"] = F.when(sub != "", occurrences(sub, ".") + 1).otherwise(0)
    out["is_https"] = flag(F.col(f"{u}.scheme") == "https")
    out["path_depth"] = occurrences(p, "/")
    out["has_suspicious_path"] = flag(F.lower(p).rlike("login|admin|verify|secure|account"))
    out |= {"query_length": F.length(q), "query_param_count": F.when(q != "", occurrences(q, "&") + 1).otherwise(0)}
    out["security_terms_count"] = sum((has(low, t) for t in SECURITY_TERMS[1:]), has(low, SECURITY_TERMS[0]))
    out |= {"entropy": F.col("_entropy"), "fragment_length": F.length(f), "domain_token_count": F.size(parts), "path_token_count": F.size(dirs)}
    out |= {"special_char_ratio": (F.length(s) - count_of(s, "alnum")) / n, "upper_case_ratio": count_of(s, "upper") / n, "vowel_ratio": share("[aeiou]", low), "consonant_ratio": share("[b-df-hj-np-tv-z]", low)}
    out["unique_char_ratio"] = F.size("_runs") / n
    out |= {f"{k}_entropy": F.col(f"_{k}_entropy") for k in ("domain", "path", "query")}
    out["entropy_ratio"] = F.when(out["entropy"] > 0, out["domain_entropy"] / out["entropy"]).otherwise(out["domain_entropy"])
    whole = F.regexp_replace(F.concat_ws(".", reg, suf), r"^\.+|\.+$", "")
    out |= {"is_shortened": flag(whole.isin(*SHORTENERS)), "domain_has_digit": flag(count_of(reg, "digit") > 0), "subdomain_has_digit": flag(count_of(sub, "digit") > 0)}
    out |= {"tld": suf, "has_suspicious_tld": flag(suf.isin(*RISKY_SUFFIXES))}
    out |= {f"contains_{t}": has(low, t) for t in TERMS}
    for b in BRANDS:
        out |= {f"contains_{b}": has(host, b), f"{b}_min_distance": F.col(f"_{b}")}
    out["min_brand_distance"] = F.least(*(out[f"{b}_min_distance"] for b in BRANDS))
    out |= {"has_multiple_subdomains": has(sub, "."), "has_suspicious_chars": flag(s.rlike("xn--|%[0-9A-Fa-f]{2}")), "has_at_symbol": has(s, "@"), "has_hexadecimal": flag(s.rlike("0x[0-9a-fA-F]+")), "has_ip_pattern": flag(s.rlike(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"))}
    out["dir_count"] = occurrences(p, "/")
    out["avg_dir_length"] = F.when(F.size(dirs) > 0, F.length(F.array_join(dirs, "")) / F.size(dirs)).otherwise(F.lit(0.0))
    out["has_file_extension_in_path"] = flag(F.lower(p).rlike(EXTENSIONS))
    out |= {"unique_2gram_ratio": distinct_grams(s, 2), "unique_3gram_ratio": distinct_grams(s, 3)}
    return out


NAMES: tuple[str, ...] = (
    "url_length", "domain_length", "path_length", *(f"count_{k}" for k in COUNTED), "count_www", "count_com", "digit_count", "letter_count", "digit_letter_ratio", "has_ip_address", "has_port", "subdomain_count", "is_https",
    "path_depth", "has_suspicious_path", "query_length", "query_param_count", "security_terms_count", "entropy", "fragment_length", "domain_token_count", "path_token_count", "special_char_ratio", "upper_case_ratio",
    "vowel_ratio", "consonant_ratio", "unique_char_ratio", "domain_entropy", "path_entropy", "query_entropy", "entropy_ratio", "is_shortened", "domain_has_digit", "subdomain_has_digit", "tld", "has_suspicious_tld",
    *(f"contains_{t}" for t in TERMS), *(x for b in BRANDS for x in (f"contains_{b}", f"{b}_min_distance")), "min_brand_distance", "has_multiple_subdomains", "has_suspicious_chars", "has_at_symbol", "has_hexadecimal",
    "has_ip_pattern", "dir_count", "avg_dir_length", "has_file_extension_in_path", "unique_2gram_ratio", "unique_3gram_ratio",
)
MATRIX = tuple(n for n in NAMES if n != "tld")


def features(df: DataFrame, url_col: str = "url", keep: tuple[str, ...] = (), names: tuple[str, ...] = NAMES, rules: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """The columns `keep` of df and the named features of its URL column; a narrow plan without UDFs. Kept columns may have any name."""
    made = expressions()
    own = [F.col(url_col).cast("string").alias("url"), *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")] if keep else [])]
    return staged(parsed(df.select(*own), "url", rules)).select(*(F.col(f"kept.`{c}`").alias(c) for c in keep), *(made[n].alias(n) for n in names))
