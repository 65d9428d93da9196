"""URL filter: fixed host and path rules, and association rules that FP-growth mines from labelled URLs.

A URL that a fixed rule fits takes that rule's verdict, and these URLs are the labels.  FP-growth runs over
transactions of URL tokens plus the label; combinations of tokens that imply a label with enough support and confidence
judge all other URLs.  A rule is filed in an inverted index under its rarest token, so a URL meets only rules that
share that token with it.

Edge cases: a null URL or one without ``://`` has empty host and path and no tokens, so no rule fits it and it gets
``DEFAULT``; the same verdict goes to URLs no mined rule matches, and to all if nothing is labelled.  Repeated rows
keep their multiplicity, in the table as in the support.  Null ids are kept.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Fixed rules: host and path prefix -> verdict; they hold for the host and all its subdomains, the longest wins.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Share of the labelled rows, and number of them, that must hold a combination and its label.
MIN_SUPPORT, MIN_ROWS = 0.002, 5
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"
#: A frequent transaction is dealt out in pieces of so many rows, so no task holds all its copies.
PIECE_ROWS = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return _lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens: scheme, words of host labels but the last, words of the path, query keys, fragment.

    Digit runs become ``#``.  The top-level domain is no token: fixed rules pick the labelled URLs by it, so in them
    it would imply its label by selection alone.
    """
    url = F.coalesce(url, F.lit(""))

    def words(text: Column, kind: str) -> Column:
        parts = F.split(F.regexp_replace(text, "[0-9]+", "#"), r"[^a-z#\x{80}-\x{10FFFF}]+")
        return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.concat(F.lit(kind), w))

    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.regexp_replace(F.substring_index(p, "=", 1), "[0-9]+", "#"))
    listed = F.concat(
        F.when(scheme != "", F.array(F.concat(F.lit("s:"), scheme))).otherwise(F.array()),
        words(F.regexp_extract(host_of(url), r"(?s)^(.*)\.", 1), "h:"),
        words(_lowered(path_of(url)), "p:"),
        F.transform(F.filter(keys, lambda k: k != ""), lambda k: F.concat(F.lit("q:"), k)),
        F.when(F.locate("#", url) > 0, F.array(F.lit("f:"))).otherwise(F.array()))
    return F.when(F.locate("://", url) > 0, F.array_sort(F.array_distinct(listed))).otherwise(F.array().cast("array<string>"))


def item_names(labelled: DataFrame, least: int, total: int) -> DataFrame:
    """(token, name) of the tokens that at least ``least`` but not all rows of ``labelled`` (tokens, label, n) hold.

    Tokens of exactly the same rows always go together and are one item, named by the first of them; else FP-growth
    would list every subset of them.  Tokens of all rows tell nothing.
    """
    mark = F.xxhash64("tokens", "label").cast("decimal(20,0)")
    each = labelled.select("n", (mark * F.col("n")).alias("mark"), F.explode("tokens").alias("token"))
    counted = (each.groupBy("token").agg(F.sum("n").alias("rows"), F.sum("mark").alias("marks"))
               .filter((F.col("rows") >= least) & (F.col("rows") < total)))
    return (counted.groupBy("rows", "marks").agg(F.collect_list("token").alias("twins"))
            .select(F.explode("twins").alias("token"), F.array_min("twins").alias("name")))


def with_items(sets: DataFrame, names: DataFrame, *by: str) -> DataFrame:
    """``sets`` (tokens, *by, n) with ``items``, the distinct names of their tokens (empty if none has a name)."""
    items = (sets.select("tokens", *by, F.explode("tokens").alias("token")).join(names, "token")
             .groupBy("tokens", *by).agg(F.collect_set("name").alias("items")))
    none = F.array().cast("array<string>")
    return sets.join(items, ["tokens", *by], "left").withColumn("items", F.coalesce("items", none))


def transactions(labelled: DataFrame, names: DataFrame) -> DataFrame:
    """(items) of every labelled row: its named tokens and its label, as often as the row occurs."""
    last = F.floor((F.col("n") - 1) / PIECE_ROWS).cast("int")
    pieces = (with_items(labelled, names, "label")
              .select("items", "label", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
              .repartition("items", "label", "piece"))
    times = F.least(F.col("n") - F.col("piece") * PIECE_ROWS, F.lit(PIECE_ROWS)).cast("int")
    item = F.concat("items", F.array(F.concat(F.lit("="), F.col("label"))))
    return pieces.select(F.explode(F.array_repeat(item, times)).alias("items"))


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS,
                min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame] | None:
    """Rules kept (antecedent, label, confidence, support) and ``item_names``; None if too little is labelled.

    ``labelled`` has (tokens, label, n).  A rule goes if one with a token less implies the same label at least as
    surely: that one matches wherever the longer one does and is preferred there, so pruning changes no verdict.
    """
    labelled = written(labelled, "url-labelled")
    total = labelled.agg(F.sum("n")).first()[0]
    if not total:
        return None
    share = max(min_support, (min_rows - 0.5) / total)
    if share > 1:
        return None
    names = written(item_names(labelled, max(min_rows, int(min_support * total)), total), "url-names")
    baskets = written(transactions(labelled, names), "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(baskets)
    found = written(
        model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit("=")) & (F.col("lift") > 1))
        .filter(~F.exists("antecedent", lambda t: F.startswith(t, F.lit("="))))
        .select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 1 << 30).alias("label"),
                "confidence", "support"), "url-rules")
    shorter = found.select("label", F.col("antecedent").alias("whole"), F.col("confidence").alias("own"),
                           F.explode("antecedent").alias("without")) \
        .withColumn("antecedent", F.array_remove("whole", F.col("without")))
    redundant = (shorter.join(found, ["antecedent", "label"]).filter(F.col("confidence") >= F.col("own"))
                 .select(F.col("whole").alias("antecedent"), "label").distinct())
    return written(found.join(redundant, ["antecedent", "label"], "left_anti"), "url-kept"), names


def inverted_index(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """(item, rule): each rule under that of its items which fewest of the URLs in ``sets`` (items, n) hold."""
    held = rules.select(F.explode("antecedent").alias("item")).distinct()
    rows = (sets.select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("rows"))
            .join(held, "item"))
    keys = (rules.select("antecedent", "label", F.explode("antecedent").alias("item")).join(rows, "item", "left")
            .groupBy("antecedent", "label").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "item")).alias("k")))
    return rules.join(keys, ["antecedent", "label"]).select(
        F.col("k.item").alias("item"), F.struct("antecedent", "label", "confidence", "support").alias("rule"))


def matched(sets: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """(tokens, label, confidence, antecedent) of the best rule of each of ``sets`` (tokens, n) that any rule matches.

    The best rule has the highest confidence, then support; then ``block`` goes before ``allow``.
    """
    sets = written(with_items(sets, names), "url-items")
    index = written(inverted_index(rules, sets), "url-index")
    met = (sets.select("tokens", "items", F.explode("items").alias("item")).join(index, "item")
           .filter(F.forall("rule.antecedent", lambda t: F.array_contains("items", t))))
    best = F.max(F.struct("rule.confidence", "rule.support", "rule.label", "rule.antecedent")).alias("best")
    return met.groupBy("tokens").agg(best).select("tokens", "best.label", "best.confidence", "best.antecedent")


def token_sets(urls: DataFrame, *by: str) -> DataFrame:
    """(tokens, *by, n): rows of each distinct token set, counted before the shuffle."""
    return urls.groupBy("tokens", *by).agg(F.count(F.lit(1)).alias("n"))


def judged(pages: DataFrame, rules: dict[str, str] = RULES, labelled: DataFrame | None = None,
           min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS,
           min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, evidence, confidence) of every row of ``pages`` (page_id, url).

    ``labelled`` (url, label) may name other labels to mine; else the URLs that ``rules`` judge are the labels.
    ``evidence`` holds the tokens of the mined rule that decided, null where a fixed rule or the default did.
    """
    url = F.col("url").cast("string")
    parts = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else None
    parts = parts.withColumn("rule", fixed_rule(F.col("host"), F.col("path"), rules))
    parts = parts.withColumn("fixed", verdicts[F.col("rule")] if rules else F.lit(None).cast("string"))
    parts = parts.withColumn("tokens", tokens_of(F.col("url"))).drop("url")
    if labelled is None:
        known = parts.filter("rule IS NOT NULL").select("tokens", F.col("fixed").alias("label"))
    else:
        known = labelled.filter("label IS NOT NULL").select(tokens_of(F.col("url").cast("string")).alias("tokens"),
                                                            F.col("label").cast("string").alias("label"))
    mined = mined_rules(token_sets(known, "label"), min_support, min_rows, min_confidence)
    ruled, rest = parts.filter("rule IS NOT NULL"), parts.filter("rule IS NULL")
    if mined is None:
        nothing = F.lit(None)
        rest = rest.select("*", nothing.cast("string").alias("label"), nothing.cast("double").alias("confidence"),
                           nothing.cast("array<string>").alias("antecedent"))
    else:
        rest = rest.join(written(matched(token_sets(rest), *mined), "url-matched"), "tokens", "left")
    return ruled.unionByName(rest, allowMissingColumns=True).select(
        "page_id", "host", "path", "rule", F.coalesce("fixed", "label", F.lit(DEFAULT)).alias("verdict"),
        F.array_join("antecedent", " ").alias("evidence"), "confidence")
