"""URL filters by association rules.

A curated list judges the URLs that it covers, and those are the labels: FP-growth mines combinations of URL tokens that go
with a verdict, and rules pruned by support, confidence and redundancy judge the URLs that the list doesn't cover. A mined
rule is indexed under the rarest token of its side, so a URL meets only the rules of tokens that it has. Rules stay a table
throughout, as many as support and confidence leave.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plinth.session import staged

BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class ListRule:
    """A verdict for a host, its subdomains, and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class MiningSettings:
    support: float = 0.002
    confidence: float = 0.9


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or #. Both are empty
    for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def listed(host: Column, path: Column, rules: list[ListRule]) -> Column:
    """struct(rule, verdict) of the longest rule of the list that fits, or null; of equally long ones the first by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def query_of(url: Column) -> Column:
    """What stands between the first ? and the # after it, past ``://``; empty where nothing does."""
    return F.coalesce(F.regexp_extract(F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)), r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the scheme, each suffix of the host, each segment of the path with its place, and each name and each name
    with its value of the query. Fragments, which no server sees, have none."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("host="), F.array_join(F.slice(labels, -n, n), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    placed = F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), s))
    scheme = F.concat(F.lit("scheme="), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    parts = F.filter(F.split(query_of(url), "[&;]"), lambda s: s != "")
    names = F.transform(parts, lambda s: F.concat(F.lit("name="), F.substring_index(s, "=", 1)))
    values = F.transform(F.filter(parts, lambda s: s.contains("=")), lambda s: F.concat(F.lit("query="), s))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(scheme), suffixes, placed, names, values)))


LABEL = "verdict="


def telling(labelled: DataFrame, settings: MiningSettings) -> tuple[DataFrame, DataFrame]:
    """(rows, classes). ``rows``: (tokens, verdict) of labelled rows with the tokens that mining needs. A token that fewer rows have
    than the support asks for is in no rule. Tokens that just the same labelled rows have are a class: a rule with one of them holds
    as well with any other, so the least stands for all, and ``classes`` (token, stands) says for which. What is left of a URL is
    short, however long it is: combinations of tokens that differ in their rows."""
    rows = staged(labelled.withColumn("_row", F.monotonically_increasing_id()), "labelled-urls")
    n = rows.count()
    each = rows.select("_row", F.explode("tokens").alias("token"))
    mark = F.xxhash64("_row")
    by = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.xxhash64(mark).cast("decimal(38,0)")).alias("s")).filter(F.col("n") >= settings.support * n)
    by = staged(by, "url-tokens")
    classes = staged(by.join(by.groupBy("n", "x", "s").agg(F.min("token").alias("stands")), ["n", "x", "s"]).select("token", "stands"), "url-classes")
    short = each.join(classes, "token").groupBy("_row").agg(F.collect_set("stands").alias("tokens"))  # a row's own tokens
    # Tokens shrink to little in a shuffle, whose size mustn't decide for a broadcast either.
    return rows.select("_row", "verdict").join(short.hint("merge"), "_row", "left").select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "verdict"), classes


def standing(urls: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (url, tokens) with the classes that they have a token of in place of the tokens, and ``own``, the least such token of each."""
    each = urls.select("url", F.explode("tokens").alias("token")).join(classes, "token").groupBy("url", "stands").agg(F.min("token").alias("token"))
    out = each.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("stands", "token"))).alias("own"))  # a URL's own tokens
    return out.select("url", F.map_keys("own").alias("tokens"), "own")


def mine(labelled: DataFrame, settings: MiningSettings) -> tuple[DataFrame, DataFrame]:
    """(rules, classes): rules (side, verdict, confidence, support) from rows (tokens, verdict), of any length, whose sides are classes
    of tokens (``telling``). A rule is redundant, and left out, if a part of its side one token shorter says the same with no less
    confidence."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    told, classes = telling(labelled, settings)
    items = staged(told.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items")), "url-items")
    if items.isEmpty():
        return spark.createDataFrame([], "side array<string>, verdict string, confidence double, support double"), classes
    rules = FPGrowth(itemsCol="items", minSupport=settings.support, minConfidence=settings.confidence).fit(items).associationRules
    rules = rules.filter(F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)) & (F.col("lift") > 1))
    rules = staged(rules.select(F.array_sort("antecedent").alias("side"), F.substring(F.col("consequent")[0], F.lit(len(LABEL) + 1), F.length(F.col("consequent")[0])).alias("verdict"), "confidence", "support"), "url-rules")
    shorter = rules.filter(F.size("side") > 1).select("side", "verdict", "confidence", F.explode("side").alias("t")).withColumn("part", F.array_except("side", F.array("t")))
    known = rules.select(F.col("side").alias("part"), "verdict", F.col("confidence").alias("c"))
    redundant = shorter.join(known, ["part", "verdict"]).filter("c >= confidence").select("side", "verdict").distinct()
    return staged(rules.join(redundant, ["side", "verdict"], "left_anti"), "url-rules-kept"), classes


def mined_verdict(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined) of distinct rows (url, tokens: classes, own) that a rule fits: struct(verdict, confidence) of the best one, by
    confidence, support, the URL's own tokens in its side, and verdict. A rule is indexed under the token of its side that the fewest
    rules have, so a URL meets the rules of its tokens only."""
    each = rules.select("side", "verdict", "confidence", "support", F.explode("side").alias("token"))
    uses = each.groupBy("token").agg(F.count("*").alias("uses"))
    index = each.join(uses, "token").groupBy("side", "verdict", "confidence", "support").agg(F.min(F.struct("uses", "token")).alias("m"))
    index = index.select(F.col("m.token").alias("token"), "side", "verdict", "confidence", "support")
    met = urls.select("url", "tokens", "own", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("side", "tokens")) == 0)
    read = F.array_sort(F.transform("side", lambda c: F.element_at("own", c)))
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), read.alias("read"), "verdict")
    best = met.groupBy("url").agg(F.min(rank).alias("b"))
    return best.select("url", F.struct(F.col("b.verdict").alias("verdict"), (-F.col("b.c")).alias("confidence")).alias("mined"))


def judge(pages: DataFrame, rules: list[ListRule], id_col: str = "page_id", url_col: str = "url", settings: MiningSettings = MiningSettings()) -> DataFrame:
    """One row for each row of ``pages``: its id, host, path, rule (the list's, else null), verdict (the rule's, else the best
    mined rule's, else allow), decided_by (list, mined or default) and confidence (of a mined rule).

    A null URL, or one without ``://``, has neither host nor path nor tokens: no mined rule can fit, so it's allowed. The
    same URL gets the same verdict in every row; null and repeated ids stay. Without a row that the list covers nothing is
    mined. Other columns play no part.
    """
    url = pages[url_col].cast("string")
    host, path = host_and_path(url)
    own = pages.select(pages[id_col].alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    own = own.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    words = tokens(F.col("url"), F.col("host"), F.col("path"))
    labelled = own.filter("listed is not null").select(words.alias("tokens"), F.col("listed.verdict").alias("verdict"))
    open_ = own.filter("listed is null and host != ''").select("url", words.alias("tokens")).dropDuplicates(["url"])  # each distinct URL is judged once
    mined, classes = mine(labelled, settings)
    # Verdicts are as many as URLs, in files far smaller than the table, so their size on disk mustn't decide for a broadcast.
    verdicts = staged(mined_verdict(standing(open_, classes), mined), "url-verdicts").hint("merge")
    out = own.join(verdicts, "url", "left").withColumn("mined", F.when(F.col("listed").isNull(), F.col("mined")))
    return out.select(
        F.col("id").alias(id_col), "host", "path", "listed.rule",
        F.coalesce("listed.verdict", "mined.verdict", F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("listed").isNotNull(), "list").when(F.col("mined").isNotNull(), "mined").otherwise("default").alias("decided_by"),
        "mined.confidence",
    )
