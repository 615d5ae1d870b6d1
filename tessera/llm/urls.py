"""URL filter: explicit host rules, and association rules mined by FP-growth, in DataFrame operations only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tessera.storage import cut, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): a host with its subdomains, then the start of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BAD, GOOD = "y=bad", "y=good"
#: Tasks over which the urls of one token set are spread where its rules are too many to broadcast.
SALTS = 32


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_column(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, else null. The rules are a short fixed list, so they are one expression."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments and query keys; digits count as `0`."""
    host, path = split_url(url)
    scheme = F.lower(F.substring_index(url, "://", 1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    marked = lambda name, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(name), p))
    flat = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    tokens = F.concat(marked("s=", F.array(scheme)), marked("h=", F.split(flat(host), r"\.")), marked("p=", F.split(flat(path), "/")), marked("q=", keys))
    return F.when(F.instr(url, "://") > 0, F.array_sort(F.array_distinct(tokens))).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = 0.0, min_count: int = 10, min_confidence: float = 0.5, min_lift: float = 1.5) -> DataFrame:
    """labelled(tokens, bad): rules (antecedent, confidence, lift, support, key) whose consequent is a bad page.

    FP-growth finds the token sets in at least min_count bad pages (and a min_support of all labelled pages, if
    that is set), so evidence counts alike at every size. Tokens in fewer bad pages can't be in a rule and go first; rules
    below min_confidence or min_lift are pruned. key is the antecedent's rarest token, under which the rule is indexed.
    Every row is a page of evidence; fewer than min_count rows, or none, give no rules. Other columns are left out.
    """
    schema = "antecedent array<string>, confidence double, lift double, support double, key string"
    total = labelled.count()
    if total < min_count:
        return labelled.sparkSession.createDataFrame([], schema)
    often = labelled.where("bad").select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    pages = cut(labelled.withColumn("page", F.monotonically_increasing_id()), "pages")
    tokens = pages.select("page", F.explode("tokens").alias("token")).join(small_side(cut(often.select("token"), "tokens"), 64), "token")
    held = pages.select("page", "bad").join(tokens.groupBy("page").agg(F.collect_set("token").alias("tokens")), "page", "left")
    none = F.array().cast("array<string>")
    items = held.select(F.array_append(F.coalesce("tokens", none), F.when(F.col("bad"), BAD).otherwise(GOOD)).alias("items"))
    # Half a page less: FP-growth multiplies the share by the total again and rounds up.
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (min_count - 0.5) / total), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0] == BAD).where(~F.array_contains("antecedent", GOOD) & (F.col("lift") >= min_lift))
    rules = cut(rules.select("antecedent", "confidence", "lift", "support"), "rules")
    seen = labelled.select(F.explode("tokens").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    rarest = rules.select("*", F.explode("antecedent").alias("key")).join(seen, "key").groupBy("antecedent", "confidence", "lift", "support").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    return cut(rarest.select("antecedent", "confidence", "lift", "support", "key"), "rules")


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets(tokens), distinct: (tokens, confidence) of those that a rule fits, with the highest confidence.

    An inverted index: every token of a set looks up the rules indexed under it, and those whose other tokens
    are there as well match.
    """
    posted = sets.select("tokens", F.explode("tokens").alias("key"))
    hits = posted.join(rules.select("key", "antecedent", "confidence"), "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def with_confidence(urls: DataFrame, matched: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """urls with the confidence of their token set in matched, else null.

    matched, a written table, is broadcast while its rows at their widest fit the limit. Beyond it the join shuffles on
    tokens and a salt, since one token set may hold a third of all urls.
    """
    widest = matched.agg(F.max(F.octet_length(F.concat_ws("", "tokens")) + 16 * F.size("tokens"))).first()[0] or 0
    if matched.count() * (widest + 64) <= limit:
        return urls.join(F.broadcast(matched), "tokens", "left")
    spread = matched.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return urls.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["tokens", "salt"], "left").drop("salt")


def judge_urls(pages: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) for every row of pages.

    An explicit rule decides where one fits. Else a page is blocked if a mined rule fits its tokens; confidence
    is then the best rule's. Labels belong to the page with their doc_id; quality 0 or toxic 1 is bad, null
    labels are neither. Urls that are null or have no `://` have no tokens and are allowed. Pages with equal
    tokens are matched once. Rows that repeat change no verdict: a page with several rows of labels is bad if one of them
    is, and a page_id counts once for each token set as evidence. An empty table of labels gives no mined rules, one
    of pages no rows. Other columns of either table are left out, whatever their names.
    """
    host, path = split_url(F.coalesce("url", F.lit("")))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), url_tokens(F.coalesce("url", F.lit(""))).alias("tokens"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    labelled = urls.select("page_id", "tokens").join(marks, "page_id").where(F.size("tokens") > 0).distinct()
    rules = mine_rules(cut(labelled.select("tokens", "bad"), "labelled"), **options)
    matched = cut(match_rules(urls.select("tokens").distinct(), rules), "matched")
    rule = rule_column(F.col("host"), F.col("path"))
    out = with_confidence(urls, matched).select("page_id", "host", "path", rule.alias("rule"), "confidence")
    stated = F.create_map(*[F.lit(x) for r in RULES for x in r])
    verdict = F.coalesce(stated[F.col("rule")], F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict)
