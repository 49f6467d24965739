"""URL filter: written rules first, then association rules mined from what they label.

Each URL is a set of tokens: the labels of its host, the segments of its path, the
names in its query, and whether it has a fragment. URLs that a written rule covers are
labelled by its verdict; a fifth of them, by a hash of the URL, is held out. Spark's
FP-growth mines frequent token combinations of the other labelled URLs together with
the verdict. A combination that implies a verdict becomes a rule if

* its support and confidence among the labelled URLs reach MIN_SUPPORT and MIN_CONFIDENCE,
* its confidence on the held-out labels reaches MIN_CONFIDENCE too, and
* at least MIN_LABELLED of all URLs that it meets are labelled: then it speaks of URLs
  like those that it was learned from (other pages of a host that is mostly blocked),
  and not of a whole top-level domain of which the written rules cover a corner;
* no part of it implies the verdict as surely.

To match, each rule is indexed under its rarest token; a URL meets the rules of its own
tokens and must hold all tokens of a rule. The surest rule decides, then the one of
more support, of more tokens, and the first by text. A URL that meets none is allowed.

Of tokens that always come together the first one stands for all (closed sets); all
other frequent tokens of a URL take part in the mining, however many. The work grows with
the number of frequent combinations, which doubles with each further frequent token that
URLs share but for a few. Matching uses all tokens.

Defined cases. A null URL, and one without "://", has an empty host and path, is
covered by no rule and is allowed unless its tokens say otherwise. Very long URLs are
read whole. Repeated rows and ids give repeated results; null ids are returned. An empty
table, and one without labels, gives no mined rule; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import tidy, written

#: Fixed rules: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LABELLED = 0.005, 0.8, 0.5
FOLDS, HELD_OUT = 5, 0
#: Rules of up to this many are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 20_000
DEFAULT = "allow"
_BLOCK, _ALLOW = "=block", "=allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """Adds host and path, both empty where the url has no "://" or is null."""
    part = lambda k: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.withColumn("host", F.translate(part(1), _UPPER, _LOWER)).withColumn("path", part(2))


def written_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest written rule that fits host and path, else null."""
    rule = verdict = F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """The token set of url, host and path."""
    marked = lambda mark, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    query = F.coalesce(F.regexp_extract("url", r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    fragment = F.when(F.col("url").contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    scheme = F.when(F.col("url").contains("://"), F.array(F.concat(F.lit("scheme:"), F.substring_index("url", "://", 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(scheme, marked("host:", F.split("host", r"\.")), marked("path:", F.split(F.lower("path"), "/")), marked("query:", names), fragment))


def held_out() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == HELD_OUT


def meet(urls: DataFrame, index: DataFrame) -> DataFrame:
    """urls with each rule (antecedent, ...) of index that they hold, found under the rule's anchor."""
    rules = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    met = urls.withColumn("anchor", F.explode("tokens")).join(rules, "anchor")
    return met.filter(F.size(F.array_except("antecedent", "tokens")) == 0)


def frequent_items(learn: DataFrame, least: float) -> DataFrame:
    """(tokens, verdict) of labelled URLs with the tokens that take part in the mining."""
    rows = written(learn.select("url", "tokens", "verdict").withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    single = rows.select("row", "verdict", F.explode("tokens").alias("token"))
    # Tokens on the same rows have equal counts and equal sums of the rows' hashes.
    seen = single.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("on")).filter(F.col("n") >= least)
    # At most the mean number of tokens of a URL over min_support.
    chosen = seen.groupBy("n", "on").agg(F.min("token").alias("token")).select("token")
    few = single.join(chosen, "token").groupBy("row", "verdict").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return written(few.select("tokens", "verdict"), "url-items")


def mine(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_labelled: float = MIN_LABELLED) -> DataFrame:
    """(anchor, antecedent, verdict, confidence, support, held_out_urls, held_out_right) from urls with url, tokens and verdict (null: no label)."""
    learn = urls.filter(F.col("verdict").isNotNull() & ~held_out())
    total = learn.count()
    items = frequent_items(learn, min_support * total)
    partitions = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, numPartitions=partitions).fit(items.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items")))
    sets = written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    verdicts = F.array(F.lit(_BLOCK), F.lit(_ALLOW))
    says = sets.filter(F.arrays_overlap("items", verdicts) & (F.size("items") > 1))
    says = says.select(F.array_except("items", verdicts).alias("antecedent"), F.substring(F.array_intersect("items", verdicts)[0], 2, 9).alias("verdict"), "freq")
    base = sets.filter(~F.arrays_overlap("items", verdicts)).select(F.col("items").alias("antecedent"), F.col("freq").alias("of"))
    rules = says.join(base, "antecedent").select("antecedent", "verdict", (F.col("freq") / F.col("of")).alias("confidence"), (F.col("freq") / F.lit(float(max(1, total)))).alias("support"))
    frequency = base.filter(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("token"), "of")
    anchored = rules.filter(F.col("confidence") >= min_confidence).withColumn("token", F.explode("antecedent")).join(frequency, "token")
    rules = written(anchored.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("of", "token")).alias("anchor")), "url-rules")

    met = meet(urls.select("tokens", F.col("verdict").alias("label"), held_out().alias("held_out")), rules)
    known, tested = F.col("label").isNotNull(), F.col("label").isNotNull() & F.col("held_out")
    told = met.groupBy("antecedent", "verdict").agg(
        F.count("*").alias("urls"),
        F.count_if(known).alias("labelled"),
        F.count_if(tested).alias("held_out_urls"),
        F.count_if(tested & (F.col("label") == F.col("verdict"))).alias("held_out_right"),
    )
    sure = told.filter((F.col("labelled") >= min_labelled * F.col("urls")) & (F.col("held_out_urls") > 0) & (F.col("held_out_right") >= min_confidence * F.col("held_out_urls")))
    rules = written(rules.join(sure.select("antecedent", "verdict", "held_out_urls", "held_out_right"), ["antecedent", "verdict"]), "url-confirmed")
    # A rule goes if a proper part of it implies the same verdict as surely; parts share a token, so they meet in the index.
    part = rules.select(F.col("antecedent").alias("part"), F.col("verdict").alias("part_verdict"), F.col("confidence").alias("part_confidence"), F.col("antecedent")[0].alias("token"))
    with_parts = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token")).join(part, "token")
    useless = with_parts.filter((F.size("part") < F.size("antecedent")) & (F.col("verdict") == F.col("part_verdict")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return written(rules.join(useless.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti"), "url-index")


@tidy
def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the tokens of the mined rule that decided) for each row of pages."""
    rule, says = written_rule(rules)
    rows = split_url(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("verdict", says).withColumn("tokens", tokens())
    index = mine(rows, **options)
    open_urls = rows.filter("rule IS NULL").select("url", "tokens").distinct()
    held = meet(open_urls, index.withColumnRenamed("verdict", "mined_verdict"))
    rank = F.struct("confidence", "support", F.size("antecedent").alias("size"), F.array_join("antecedent", " ").alias("text"))
    best = held.groupBy("url").agg(F.max_by(F.struct(F.col("mined_verdict").alias("verdict"), "antecedent"), rank).alias("best"))
    found = rows.join(best.select(F.col("url").alias("met_url"), "best"), rows["url"].eqNullSafe(F.col("met_url")), "left")
    mined = F.when(F.col("rule").isNull(), F.col("best.antecedent"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.col("best.verdict"), F.lit(DEFAULT)).alias("verdict"), mined.alias("mined"))
