import sys
import unicodedata

from pyspark.sql import functions as F

from sparkwarden.functions.characters import KINDS, count_of
from sparkwarden.operators.features import features


def test_every_assigned_code_point(spark):
    """Counts in texts of 150 neighbours, between ASCII, for each class; and one by one where neighbours would hide two errors."""
    assigned = [chr(k) for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k)) not in ("Cn", "Cs", "Co")]
    texts = ["aZ9-" + "".join(assigned[k : k + 150]) for k in range(0, len(assigned), 150)] + [c for c in assigned if any(f(c) for f, _ in KINDS.values()) and not c.isalpha()]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    for r in df.select("t", *(count_of(F.col("t"), k).alias(k) for k in KINDS)).collect():
        assert {k: r[k] for k in KINDS} == {k: sum(map(f, r.t)) for k, (f, _) in KINDS.items()}


def test_features_count_them(spark):
    """Features 16, 17, 18, 32, 33, 42 and 43 as Python gives them."""
    urls = ["http://a²b.c①.com/Ⅷ/Ⓐ?ß=Ü", "http://x.com/٣४Ǆǅ", "http://①②.ß.com/", "abc", "", "http://日本.com/ー々〇ªº"]
    got = {r.url: r for r in features(spark.createDataFrame([(u,) for u in urls], "url string"), keep=("url",), names=("digit_count", "letter_count", "digit_letter_ratio", "special_char_ratio", "upper_case_ratio", "domain_has_digit", "subdomain_has_digit")).collect()}
    for u, r in got.items():
        digits, letters, n = sum(map(str.isdigit, u)), sum(map(str.isalpha, u)), max(len(u), 1)
        assert (r.digit_count, r.letter_count, r.digit_letter_ratio) == (digits, letters, digits / (letters + 1))
        assert (r.special_char_ratio, r.upper_case_ratio) == (sum(not c.isalnum() for c in u) / n, sum(map(str.isupper, u)) / n)
    assert got[urls[0]].subdomain_has_digit == 1 and got[urls[0]].domain_has_digit == 1 and got[urls[2]].subdomain_has_digit == 1 and got[urls[5]].domain_has_digit == 0
