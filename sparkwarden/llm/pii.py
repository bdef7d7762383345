"""Personal data by weak supervision, in DataFrame functions only.

Regexes propose candidates; regex, gazetteer and context labelers vote for or against each, or abstain; expectation-maximisation over
the counts of vote patterns estimates each labeler's reliability for each kind without labels. A logistic span classifier over votes
and features of the span itself is trained on the posteriors and decides about every candidate that the base rules don't settle. Base
matches always stay, and take no part in the estimates.

Places of matches come from the lengths of what lies between them (split) and of the matches themselves,
summed up in blocks, so that a text with very many matches stays linear.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
#: The base rules. Possessive and guarded forms match the same spans as the plain ones, without backtracking over long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule to be worth trying.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Further candidates, tried in this order at each place.
MORE = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+.(-])(?<!\+[0-9]{1,3}\x20)\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{20,}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
}
MORE_HINT = r"[0-9].{0,3}[0-9A-Za-z]|[\[(]at[\])]"
#: Gazetteers and cue words of the labelers, by kind.
TLDS = "com org net edu gov int mil info biz name io ai app dev co me tv eu us uk de fr es it nl be ch at se no dk fi pl pt ie cz gr ro hu ru ua tr cn jp in kr au nz br ca mx ar za".split()
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24}
SECRET_PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "pk_live_", "sk_live_", "AKIA", "ASIA", "AIza", "xoxb-", "xoxp-", "xoxa-", "eyJ", "SG.", "npm_", "pypi-")
FAKE_SSNS = ("078-05-1120", "219-09-9999", "457-55-5462", "123-45-6789")
CUES = {
    "email": "mail|contact|write to|reach",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|dial",
    "secret": "token|secret|passw|pwd|api.?key|bearer|auth|credential|private.?key|access.?key",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "ssn": "ssn|social.?security|social|taxpayer",
}
AGAINST = r"(?i)(?:isbn|issn|doi|version|page|order|invoice|chapter|commit|revision|build|figure|part no|serial|model|sku|article|ticket|case|#)[^\n\p{L}]{0,6}$"
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)+$",
    "phone": r"^\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}$|^([0-9]{3}([.-])[0-9]{3}\2[0-9]{4})$",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Za-z0-9]{32,})$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4})+(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]+)$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
}
VOTERS = ("shape", "valid", "cue", "against", "assigned", "gazetteer", "isolated")
#: Features of a span, each in so many bins: length, shares of digits, capitals and distinct characters, both cases, separators.
BINS = {"length": 8, "digits": 5, "capitals": 4, "distinct": 4, "cases": 2, "parts": 3}


def _found(text: str, pattern: str, hint: str, block: int = 256) -> str:
    """SQL for array<struct<s, e, v>>: start, end and value of all matches, leftmost and without overlap."""
    kind = "struct<s:int,e:int,v:string>"
    steps = f"filter(zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (g, v) -> struct(length(g) AS g, v AS v)), x -> x.v IS NOT NULL)"
    inner = f"aggregate(slice(w, b * {block} + 1, {block}), cast(struct(0, array()) AS struct<at:int,out:array<{kind}>>), (t, x) -> struct(t.at + x.g + length(x.v) AS at, array_append(t.out, struct(t.at + x.g AS s, t.at + x.g + length(x.v) AS e, x.v AS v)) AS out))"
    blocks = f"transform(sequence(0, (greatest(size(w), 1) - 1) div {block}), b -> {inner})"
    outer = f"aggregate({blocks}, cast(struct(0, array()) AS struct<at:int,out:array<array<{kind}>>>), (t, x) -> struct(t.at + x.at AS at, array_append(t.out, transform(x.out, y -> struct(y.s + t.at AS s, y.e + t.at AS e, y.v AS v))) AS out))"
    return f"if({text} RLIKE r'{hint}', element_at(transform(array({steps}), w -> flatten({outer}.out)), 1), cast(array() AS array<{kind}>))"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, r'[^0-9]', '')"


def _luhn(v: str) -> str:
    place = "cast(substr(d, length(d) - i + 1, 1) AS int)"
    total = f"aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, {place}, 2 * {place} - if({place} > 4, 9, 0)))"
    return f"element_at(transform(array({_digits(v)}), d -> if(length(d) BETWEEN 12 AND 19, {total} % 10 = 0, false)), 1)"


def _mod97(v: str) -> str:
    turned = f"filter(split(concat(substring(c, 5), substring(c, 1, 4)), ''), k -> k <> '')"
    step = "(r, k) -> if(k RLIKE '[0-9]', (r * 10 + int(k)) % 97, (r * 100 + ascii(k) - 55) % 97)"
    return f"element_at(transform(array(replace({v}, ' ', '')), c -> aggregate({turned}, 0, {step}) = 1), 1)"


#: The base rules' checks.
BASE_VALID = {
    "email": "true",
    "ip": "forall(split(x.v, r'[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', right(p, 3)) AS int) <= 255)",
    "card": _luhn("x.v"),
    "phone": f"length({_digits('x.v')}) BETWEEN 9 AND 15",
}


def _either(yes: str, no: str = "") -> str:
    """SQL of a vote: 1 for, 2 against, 0 to abstain."""
    return f"CASE WHEN {yes} THEN 1 WHEN {no or 'false'} THEN 2 ELSE 0 END"


def _words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_COUNTRY = f"element_at(map({', '.join(f"'{c}', {n}" for c, n in IBAN_LENGTH.items())}), substring(x.v, 1, 2))"
_RICH = "size(array_distinct(split(x.v, ''))) >= 10 AND x.v RLIKE r'[0-9].*[0-9].*[0-9].*[0-9]'"
_AREA = "x.v RLIKE r'^(?:000|666|9)|-00-|-0000$'"
_NUMBER = f"{_digits('x.v')} RLIKE r'^[2-9][0-9]{{2}}[2-9]'"
_TLD = f"element_at(split(lower(x.v), r'[^a-z0-9]+'), -1) IN ({_words(TLDS)})"
#: The kinds' checks and gazetteers as votes.
VALID = {"email": _either(_TLD, "NOT x.v RLIKE r'[A-Za-z]{2,}$'"), "phone": _either(_NUMBER, f"NOT {_NUMBER}"), "secret": _either(_RICH, f"NOT ({_RICH})"), "iban": _either(_mod97("x.v"), f"NOT {_mod97('x.v')}"), "ssn": _either(f"NOT {_AREA}", _AREA)}
KNOWN = {
    "email": _either(r"x.v RLIKE r'(?i)[\[(]dot[\])]'"),
    "phone": _either("false", f"{_digits('x.v')} RLIKE r'^(?:([0-9])\\1{{9}}|1234567890)$'"),
    "secret": _either(" OR ".join(f"startswith(x.v, '{p}')" for p in SECRET_PREFIXES), "x.v RLIKE r'^(?:[A-Za-z]+[/_-])+[A-Za-z]*[0-9]{0,4}$'"),
    "iban": _either(f"coalesce({_COUNTRY} = length(replace(x.v, ' ', '')), false)", f"coalesce({_COUNTRY} <> length(replace(x.v, ' ', '')), true)"),
    "ssn": _either("false", f"x.v IN ({_words(FAKE_SSNS)})"),
}


def _base(kind: str, found: str) -> str:
    """SQL for the structs of a base rule's matches: settled, and base where its check holds."""
    return f"transform({found}, x -> struct(x.s AS s, {KINDS.index(kind)} AS rank, x.e AS e, {BASE_VALID[kind]} AS base, 0 AS votes, 0 AS feat, true AS settled))"


def _more(text: str, kind: str, found: str) -> str:
    """SQL for the structs of further candidates of one kind, with their votes (two bits each) and features."""
    before, after = f"substring({text}, greatest(x.s - 39, 1), least(x.s, 40))", f"substring({text}, x.e + 1, 1)"
    votes = {
        "shape": _either(f"x.v RLIKE r'{SHAPES[kind]}'"), "valid": VALID[kind], "cue": _either(f"x.before RLIKE r'(?i)(?:{CUES[kind]})[^\\n]{{0,24}}$'"), "against": _either("false", f"x.before RLIKE r'{AGAINST}'"),
        "assigned": _either("x.before RLIKE r'[=:]\\s{0,2}[\"(<\\[]?$'"), "gazetteer": KNOWN[kind], "isolated": _either("false", "x.before RLIKE r'[\\p{L}\\p{N}]$' OR x.after RLIKE r'^[\\p{L}\\p{N}]'"),
    }
    bits = " + ".join(f"{4**k} * ({votes[name]})" for k, name in enumerate(VOTERS))
    many = lambda kept: f"length(regexp_replace(x.v, r'[^{kept}]', ''))"
    bins = {
        "length": "least(7, length(x.v) div 6)", "digits": f"{many('0-9')} * 4 div length(x.v)", "capitals": f"{many('A-Z')} * 3 div length(x.v)", "distinct": "least(3, size(array_distinct(split(x.v, ''))) * 4 div length(x.v))",
        "cases": "if(x.v RLIKE r'[A-Z]' AND x.v RLIKE r'[a-z]', 1, 0)", "parts": f"least(2, {many(' ./_()-')} div 2)",
    }
    code, size = [], 1
    for name, n in BINS.items():
        code.append(f"{size} * ({bins[name]})")
        size *= n
    seen = f"transform({found}, x -> struct(x.s AS s, x.e AS e, x.v AS v, {before} AS before, {after} AS after))"
    return f"transform({seen}, x -> struct(x.s AS s, {KINDS.index(kind)} AS rank, x.e AS e, false AS base, cast({bits} AS int) AS votes, cast({' + '.join(code)} AS int) AS feat, false AS settled))"


def candidates(t: str) -> Column:
    """array<struct<s, rank, e, base, votes, feat, settled>> of the text column named t, by start and kind.

    base: a base match that stays. settled: the base rules have spoken, for or against. votes: two bits for each of VOTERS. feat: the bins of
    BINS as one number.
    """
    parts = [_base(k, _found(t, p, HINT[k])) for k, p in BASE.items()]
    any_more = "|".join(f"(?:{p})" for p in MORE.values())
    of_kind = {k: " AND ".join([f"x.v RLIKE r'^(?:{_plain(MORE[k])})$'"] + [f"NOT x.v RLIKE r'^(?:{_plain(MORE[j])})$'" for j in list(MORE)[:n]]) for n, k in enumerate(MORE)}
    more = [_more(t, k, f"filter(m, x -> {of_kind[k]})") for k in MORE]
    rest = f"element_at(transform(array({_found(t, any_more, MORE_HINT)}), m -> if(size(m) = 0, cast(array() AS array<struct<s:int,rank:int,e:int,base:boolean,votes:int,feat:int,settled:boolean>>), concat({', '.join(more)}))), 1)"
    return F.expr(f"sort_array(concat({', '.join(parts)}, {rest}))")


def _plain(pattern: str) -> str:
    """A candidate's rule without its guards before and after, to name a value's kind."""
    return pattern.replace(r"(?<![0-9-])", "").replace(r"(?![0-9-])", "").replace(r"(?<![A-Za-z0-9])", "").replace(r"(?![A-Za-z0-9])", "").replace(r"(?<![0-9+.(-])(?<!\+[0-9]{1,3}\x20)", "").replace(r"(?![0-9.-])", "").replace(r"(?<![A-Za-z0-9+/_=-])", "").replace(r"(?<![A-Za-z0-9._%+-])", "")


def scanned(docs: DataFrame) -> DataFrame:
    """docs with _pii, the candidates of the whole text."""
    own = docs.withColumn("_pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return own.withColumn("_pii", candidates("_pii_text")).drop("_pii_text")


#: What a labeler is taken to do before any text is seen, as counts: its share of votes for and against on true and on false spans.
BELIEF = {"for": (0.5, 0.1), "against": (0.05, 0.4)}
STRENGTH = 4.0


@dataclass
class Reliabilities:
    """For each kind the prior of a true span, and for each labeler the log odds that its votes for and against add. To abstain adds nothing."""

    prior: list[float]
    odds: list[list[tuple[float, float]]]

    @classmethod
    def believed(cls) -> Reliabilities:
        start = (math.log(BELIEF["for"][0] / BELIEF["for"][1]), math.log(BELIEF["against"][0] / BELIEF["against"][1]))
        return cls([0.5] * len(KINDS), [[start] * len(VOTERS) for _ in KINDS])

    def posterior(self) -> Column:
        """Of a true span, from rank and votes."""
        base = F.lit([math.log(p / (1 - p)) for p in self.prior])
        added = F.lit([x for kind in self.odds for yes, no in kind for x in (0.0, yes, no, 0.0)])
        total = F.get(base, F.col("rank"))
        for k in range(len(VOTERS)):
            total = total + F.get(added, (F.col("rank") * len(VOTERS) + k) * 4 + vote(F.col("votes"), k))
        return 1 / (1 + F.exp(-total))


def vote(votes: Column, k: int) -> Column:
    return F.shiftright(votes, 2 * k).bitwiseAND(F.lit(3))


def reliabilities(patterns: DataFrame, rounds: int = 12) -> Reliabilities:
    """Estimates for each kind from patterns(rank, votes, n), by expectation-maximisation from BELIEF, which weighs as STRENGTH spans of each class.

    A vote for a span never lowers its odds and one against never raises them. Each round is one aggregate, to a row
    for each kind, labeler and vote.
    """
    each = F.array(*(F.struct(F.lit(k).alias("k"), vote(F.col("votes"), k).alias("v")) for k in range(len(VOTERS))))
    now = Reliabilities.believed()
    for _ in range(rounds):
        sided = patterns.withColumn("p", now.posterior()).select("rank", (F.col("p") * F.col("n")).alias("true"), ((1 - F.col("p")) * F.col("n")).alias("false"), F.inline(each))
        sums: dict[int, dict[tuple[int, int], tuple[float, float]]] = {}
        for r in sided.groupBy("rank", "k", "v").agg(F.sum("true").alias("t"), F.sum("false").alias("f")).collect():
            sums.setdefault(r["rank"], {})[r["k"], r["v"]] = (r["t"], r["f"])
        now = Reliabilities.believed()
        for rank, voted in sums.items():
            both = [sum(x[j] for (k, _), x in voted.items() if k == 0) for j in (0, 1)]
            now.prior[rank] = (both[0] + STRENGTH / 2) / (sum(both) + STRENGTH)
            for k in range(len(VOTERS)):
                share = {v: [(x + STRENGTH * belief) / (n + STRENGTH) for x, belief, n in zip(voted.get((k, v), (0.0, 0.0)), BELIEF[side], both)] for v, side in ((1, "for"), (2, "against"))}
                now.odds[rank][k] = (max(0.0, math.log(share[1][0] / share[1][1])), min(0.0, math.log(share[2][0] / share[2][1])))
    return now


def _slots(rank: Column, votes: Column, feat: Column) -> list[tuple[Column, int]]:
    """The classifier's inputs: each a number below its size."""
    out, place = [(rank, len(KINDS)), *((vote(votes, k), 3) for k in range(len(VOTERS)))], 1
    for n in BINS.values():
        out.append((F.floor(feat / place).cast("int") % n, n))
        place *= n
    return out


@dataclass
class SpanClassifier:
    """An intercept and a weight for each value of each input."""

    intercept: float
    weights: list[float]

    def odds(self, x: Column) -> Column:
        total, at, table = F.lit(self.intercept), 0, F.lit(self.weights)
        for number, n in _slots(x["rank"], x["votes"], x["feat"]):
            total = total + F.get(table, number + at)
            at += n
        return total


def classifier(scans: DataFrame) -> SpanClassifier:
    """The span classifier, learnt from the posteriors of all unsettled candidates of scans(_pii); without any, one that takes nothing."""
    found = scans.select(F.explode(F.filter("_pii", lambda x: ~x["settled"])).alias("c")).select("c.rank", "c.votes", "c.feat")
    patterns = cut(found.groupBy("rank", "votes", "feat").agg(F.count("*").alias("n")))
    slots = _slots(*map(F.col, ("rank", "votes", "feat")))
    if patterns.isEmpty():
        return SpanClassifier(-1.0, [0.0] * sum(n for _, n in slots))
    p = reliabilities(patterns.groupBy("rank", "votes").agg(F.sum("n").alias("n"))).posterior()
    x = F.array(*((number == v).cast("double") for number, n in slots for v in range(n)))
    sides = F.array(F.struct(F.lit(1.0).alias("y"), (p * F.col("n")).alias("w")), F.struct(F.lit(0.0).alias("y"), ((1 - p) * F.col("n")).alias("w")))
    rows = patterns.select(array_to_vector(x).alias("x"), F.explode(sides).alias("s")).select("x", "s.y", "s.w")
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-3, maxIter=50, standardization=False).fit(rows)
    return SpanClassifier(float(fitted.intercept), [float(w) for w in fitted.coefficients.toArray().tolist()])


def accepted(model: SpanClassifier, least: float = 0.5) -> Column:
    """The spans of _pii that stay: base matches, and unsettled candidates that the classifier gives at least `least`."""
    cutoff = math.log(least / (1 - least))
    stays = lambda x: x["base"] | (~x["settled"] & (model.odds(x) >= cutoff))
    return F.array_distinct(F.transform(F.filter("_pii", stays), lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["base"].alias("base"))))


def _shown(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined).

    Offsets count code points, ends are exclusive. Null and empty texts have no spans (digest of the empty string).
    Rows are handled one by one; repeated or null doc_ids give as many rows; other columns are ignored.
    """
    scans = cut(scanned(docs.select("doc_id", "text")).select("doc_id", "_pii"))
    model = classifier(scans)
    spans = scans.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter("_pii", lambda x: x["base"]).alias("_base"), accepted(model).alias("_all"))
    count = lambda k: F.size(F.filter("_base", lambda x: x["rank"] == k)).cast("long")
    counts = [count(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return spans.select("doc_id", *counts, F.sha2(_shown(F.col("_base")), 256).alias("base_sha256"), _shown(F.col("_all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every accepted span replaced by its kind in brackets; overlapping spans become one. n_chars, if there, follows.

    Null texts stay null; rows without spans stay as they are.
    """
    rest = [c for c in docs.columns if c != "text"]
    own = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in rest or ["text"])).alias("rest"))  # columns of any name
    scans = cut(scanned(own))  # each text is scanned once; the table written holds texts and spans
    kind = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    marked = scans.withColumn("_pii", accepted(classifier(scans)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(t: Column, x: Column) -> Column:
        fresh = x["s"] >= t["at"]
        head = F.substring(F.col("text"), t["at"] + 1, x["s"] - t["at"])
        return F.struct(F.when(fresh, F.concat(t["out"], head, F.get(kind, x["rank"]))).otherwise(t["out"]).alias("out"), F.greatest(t["at"], x["e"]).alias("at"))

    def end(t: Column) -> Column:
        return F.concat(t["out"], F.substring(F.col("text"), t["at"] + 1, F.lit(2**31 - 1)))

    made = {"text": F.when(F.size("_pii") > 0, F.aggregate("_pii", start, step, end)).otherwise(F.col("text"))}
    out = marked.withColumn("text", made["text"])
    made["text"] = F.col("text")
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(made.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
