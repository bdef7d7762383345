import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from sparkwarden.llm import pii
from tests.llm.data import docs, odd

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    found = [(m.start(), n, m.end()) for n, (k, p) in enumerate(RULES.items()) for m in re.finditer(p, text or "") if good(k, m[0])]
    shown = [f"{list(RULES)[n]}:{s}:{e}" for s, n, e in sorted(found)]
    return [sum(n == k for _, n, _ in found) for k in range(4)], hashlib.sha256(",".join(shown).encode()).hexdigest(), shown


def check(rows, texts):
    for r in rows:
        counts, digest, shown = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id][:200]
        assert r.base_sha256 == digest
        assert set(shown) <= set(r.spans.split(","))


def test_base_spans_on_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    rows = pii.find(table).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    secrets = {i: m.span(1) for i, t in texts.items() for m in [re.search('token = "([0-9a-f]{40})"', t)] if m}
    caught = sum(f"secret:{s}:{e}" in r.spans.split(",") for r in rows if r.doc_id in secrets for s, e in [secrets[r.doc_id]])
    assert secrets and caught >= 0.95 * len(secrets)


def test_base_spans_on_random_strings(spark):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "22", "4111 1111 1111 1111", "255", "256", " ", "(", ")", "é", "😀", "%", "\n", "0", "+1 (613) 555-8758", "x@y.z", "1.2.3.4", "5105105105105100"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))), "a") for k in range(1500)]
    check(pii.find(docs(spark, rows)).collect(), {i: t for i, t, _ in rows})


def test_many_matches_in_one_text(spark):
    text = "a.b@c.de 10.0.0.1 " * 3000
    (row,) = pii.find(docs(spark, [(1, text, "a")])).collect()
    check([row], {1: text})


def test_long_runs(spark):
    rows = [(1, "1" * 20_000, "a"), (2, "a" * 20_000 + "@", "a"), (3, "1 " * 20_000, "a"), (4, "+1" + " -" * 20_000, "a"), (5, "1.2.3.4." * 2_000, "a"), (6, "a@b" + ".c" * 10_000, "a")]
    check(pii.find(docs(spark, rows)).collect(), {i: t for i, t, _ in rows})


def iban(rng, country="DE", n=22):
    body = "".join(rng.choice("0123456789") for _ in range(n - 4))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    v = f"{country}{check:02d}{body}"
    return " ".join(v[k : k + 4] for k in range(0, n, 4))


def planted(rng):
    """(kind, sentence with one true span or one look-alike, the value, whether it is true)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))
    ssn = f"{rng.randint(100, 660)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    phone = f"({rng.randint(201, 989)}) {rng.randint(201, 989)}-{digits(4)}"
    good_iban = iban(rng, *rng.choice([("DE", 22), ("FR", 27), ("GB", 22), ("ES", 24)]))
    return [
        ("iban", f"please transfer to iban {good_iban} soon", good_iban, True),
        ("iban", f"part no {(v := f'ZZ{digits(2)} {digits(4)} {digits(4)} {digits(4)}')} in stock", v, False),
        ("ssn", f"his ssn: {ssn} was leaked", ssn, True),
        ("ssn", f"invoice 000-{(v := digits(2))}-0000 was paid", f"000-{v}-0000", False),
        ("phone", f"call me at {phone} tonight", phone, True),
        ("phone", f"order {(v := f'111 1{digits(2)} {digits(4)}')} has shipped", v, False),
        ("secret", f'api_key = "{key}" is live', key, True),
        ("secret", f"see the page {(v := 'some-rather/long_path-of-words-' + digits(1))} for more", v, False),
        ("email", f"write to {(v := f'joe{digits(3)} [at] mail [dot] com')} for help", v, True),
    ]


def spans_of(spark, cases):
    rows = [(k, f"word {k} {text} and so on", "a") for k, (_, text, _, _) in enumerate(cases)]
    got = {r.doc_id: set(r.spans.split(",")) for r in pii.find(docs(spark, rows)).collect()}
    out = {}
    for k, (kind, _, v, true) in enumerate(cases):
        at = rows[k][1].index(v)
        out.setdefault((kind, true), []).append(f"{kind}:{at}:{at + len(v)}" in got[k])
    return {k: sum(v) / len(v) for k, v in out.items()}


def test_planted_spans_and_look_alikes(spark):
    rng = random.Random(5)
    share = spans_of(spark, [c for _ in range(60) for c in planted(rng)])
    assert all(share[k, True] >= 0.95 for k in ("iban", "ssn", "phone", "secret", "email")), share
    assert all(share[k, False] <= 0.05 for k in ("iban", "ssn", "phone", "secret")), share


def test_a_kind_with_one_candidate_follows_belief(spark):
    rng = random.Random(6)
    share = spans_of(spark, planted(rng))
    assert all(v == k[1] for k, v in share.items()), share


def naive(patterns, rounds=12):
    """reliabilities by plain loops: {rank: (prior, odds)}."""
    belief = {1: pii.BELIEF["for"], 2: pii.BELIEF["against"]}
    state = {r: (0.5, [{v: math.log(a / b) for v, (a, b) in belief.items()} for _ in pii.VOTERS]) for r in {r for r, _, _ in patterns}}
    digit = lambda votes, k: votes // 4**k % 4
    for _ in range(rounds):
        new = {}
        for rank, (prior, odds) in state.items():
            true, false, voted = 0.0, 0.0, {}
            for r, votes, n in patterns:
                if r == rank:
                    z = math.log(prior / (1 - prior)) + sum(odds[k].get(digit(votes, k), 0.0) for k in range(len(pii.VOTERS)))
                    p = 1 / (1 + math.exp(-z))
                    true, false = true + p * n, false + (1 - p) * n
                    for k in range(len(pii.VOTERS)):
                        x = voted.setdefault((k, digit(votes, k)), [0.0, 0.0])
                        x[0] += p * n
                        x[1] += (1 - p) * n
            rates = lambda k, v: [(s + 4 * b) / (n + 4) for s, b, n in zip(voted.get((k, v), (0, 0)), belief[v], (true, false))]
            logs = lambda k, v: math.log(rates(k, v)[0] / rates(k, v)[1])
            new[rank] = ((true + 2) / (true + false + 4), [{1: max(0, logs(k, 1)), 2: min(0, logs(k, 2))} for k in range(len(pii.VOTERS))])
        state = new
    return state


def test_reliabilities_match_plain_loops(spark):
    rng = random.Random(7)
    patterns = [(rng.choice([0, 4, 5]), sum(rng.choice([0, 0, 1, 2]) * 4**k for k in range(len(pii.VOTERS))), rng.randint(1, 50)) for _ in range(80)]
    got = pii.reliabilities(spark.createDataFrame(patterns, "rank int, votes int, n long"))
    for rank, (prior, odds) in naive(patterns).items():
        assert abs(got.prior[rank] - prior) < 1e-9
        assert all(abs(got.odds[rank][k][v - 1] - odds[k][v]) < 1e-9 for k in range(len(pii.VOTERS)) for v in (1, 2))
    assert got.odds[1] == pii.Reliabilities.believed().odds[1]


def test_redaction_scans_once(spark, monkeypatch):
    seen = []
    scan = pii.scanned
    monkeypatch.setattr(pii, "scanned", lambda df: seen.append(1) or scan(df))
    assert pii.redact(docs(spark, [(1, "a@b.cd", "a"), (1, "a@b.cd", "a"), (None, "x", "a")])).count() == 3
    assert len(seen) == 1


def test_redaction(spark):
    rows = [(1, 'é mail x@y.zz, call +1 (613) 555-8758. token = "d79b4bd5ac35c6fd4765f3c195ae8bf92c95a355" end', "a"), (2, "nothing here", "a"), (3, None, "a")]
    rows += [(10 + k, f"mail u{k}@mail{k % 9}.example.com or 4{k} words {k}.{k}.{k}.{k}", "a") for k in range(40)]
    out = {r.doc_id: r for r in pii.redact(docs(spark, rows)).collect()}
    assert out[1].text.startswith("é mail [EMAIL], call [PHONE]. ") and out[1].n_chars == len(out[1].text)
    assert out[2].text == "nothing here" and out[3].text is None
    assert out[12].text == "mail [EMAIL] or 42 words [IP]"


def test_odd_rows_and_empty(spark):
    got = pii.find(odd(spark)).collect()
    assert len(got) == 10
    same = pii.redact(odd(spark))
    assert same.columns == odd(spark).columns and same.count() == 10 and {r["_pii"] for r in same.collect()} == {"x"}
    assert [r.text for r in pii.redact(docs(spark, [(1, "to a.b@c.de", "a")]).select("text")).collect()] == ["to [EMAIL]"]
    assert pii.find(docs(spark, [])).collect() == []
    assert [r.spans for r in pii.find(docs(spark, [(1, "", "a"), (2, None, None)])).collect()] == ["", ""]
