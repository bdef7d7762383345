"""Scoring visits: event filter, trusted-domain bypass, verdicts and feedback, alike in batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions.text import fresh

#: Hosts that are trusted without a model.
TRUSTED = (
    "github.com", "google.com", "wikipedia.org", "facebook.com", "twitter.com", "linkedin.com", "youtube.com", "amazon.com", "apple.com", "microsoft.com", "bbc.com", "nytimes.com", "cnn.com",
    "instagram.com", "reddit.com", "pinterest.com", "dropbox.com", "adobe.com", "reuters.com", "bloomberg.com", "theguardian.com", "aljazeera.com", "stackoverflow.com", "leetcode.com", "codeforces.com", "codechef.com",
)
MODEL_TYPE = "urlset_ensemble"
ALIVE = "5 minutes"
#: Records of the prediction log.
LOG = "url string, prediction int, probability double, model_type string, timestamp timestamp"


def completed(events: DataFrame) -> DataFrame:
    """Finished page loads; both filters reach a Parquet scan."""
    return events.where((F.col("status") == "complete") & F.col("url").startswith("http"))


def trust_key(netloc: Column) -> Column:
    return F.regexp_replace(netloc, r"^www\.", "")


def score(visits: DataFrame, model: Callable[[DataFrame], DataFrame], trusted: tuple[str, ...] = TRUSTED) -> DataFrame:
    """visits with prediction, probability and whitelisted; only hosts that aren't trusted go through `model`.

    Each distinct URL is judged once, however often it is visited: `model` is given url alone and adds prediction and probability. URLs go to it in a partition for each core:
    they are few bytes and much work, and would else be put together by their bytes.
    The verdicts have one row a URL, so a hot URL only makes its visits' side of the join skewed, which is split at run time. A null URL
    is not trusted; columns of visits that are named like a verdict's are replaced.
    """
    verdict = ("prediction", "probability", "whitelisted")
    urls = visits.select("url").distinct()
    known = F.coalesce(trust_key(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)).isin(*trusted), F.lit(False))
    passed = urls.where(known).select("url", F.lit(0).alias("prediction"), F.lit(1.0).alias("probability"), F.lit(True).alias("whitelisted"))
    judged = model(urls.where(~known).repartition(visits.sparkSession.sparkContext.defaultParallelism, "url")).select("url", "prediction", "probability", F.lit(False).alias("whitelisted"))
    of = fresh(visits, "url")
    verdicts = passed.unionByName(judged).withColumnRenamed("url", of)
    return visits.drop(*verdict).join(verdicts, F.col("url").eqNullSafe(F.col(of))).drop(of)


def prediction_log(scored: DataFrame, now: Column | None = None) -> DataFrame:
    """Records of the model's side; trusted visits are not logged."""
    return scored.where(~F.col("whitelisted")).select("url", "prediction", "probability", F.lit(MODEL_TYPE).alias("model_type"), (now if now is not None else F.current_timestamp()).alias("timestamp"))


def message(scored: DataFrame) -> DataFrame:
    bad = F.col("prediction") == 1
    return scored.withColumns({
        "title": F.when(bad, "Phishing Warning!").otherwise("URL Looks Safe"),
        "message": F.concat(F.when(bad, "Potential phishing detected for:\n").otherwise("This URL appears to be safe:\n"), F.col("url")),
        "priority": F.when(bad, 2).otherwise(0),
    })


def button_label(button: Column) -> Column:
    return F.when(button == 0, 0).otherwise(1)


def valid_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the label must be 0 or 1."""
    ok = F.coalesce(F.col("reported_label").isin(0, 1), F.lit(False))
    return reports.where(ok), reports.where(~ok)


def clicks_on_live(shown: DataFrame, clicks: DataFrame) -> DataFrame:
    """Clicks (id, click_ts, button) on notifications (id, shown_ts, url) that are at most five minutes old; serves streams too if both have watermarks."""
    of = fresh(shown, "id")
    live = (F.col("click_ts") >= F.col("shown_ts")) & (F.col("click_ts") < F.col("shown_ts") + F.expr(f"interval {ALIVE}"))
    return shown.join(clicks.withColumnRenamed("id", of), (F.col("id") == F.col(of)) & live).drop(of)


def first_click(matched: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """The earliest click of each notification."""
    place = fresh(matched, "place")
    w = Window.partitionBy(*by).orderBy("click_ts", "button")
    return matched.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def unless_closed(matched: DataFrame, closes: DataFrame) -> DataFrame:
    """Clicks without an earlier close (id, close_ts) of their notification."""
    of = fresh(matched, "id")
    c = closes.select(F.col("id").alias(of), "close_ts")
    return matched.join(c, (F.col("id") == F.col(of)) & (F.col("close_ts") <= F.col("click_ts")) & (F.col("close_ts") >= F.col("shown_ts")), "left_anti")


def feedback(matched: DataFrame, now: Column | None = None) -> DataFrame:
    return matched.select("url", button_label(F.col("button")).alias("reported_label"), (now if now is not None else F.current_timestamp()).alias("timestamp"))
