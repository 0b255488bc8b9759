"""URL filter by given rules and mined association rules (operator 2).

A given rule (host and beginning of the path) fits its host, all subdomains and all paths that begin so;
the longest rule that fits a url decides. For other urls, association rules decide: combinations of up to
three url tokens that are frequent among labelled pages together with the label "bad". A combination
needs support (bad pages that have it) and confidence. Confidence is the share of bad pages among those that
have it, and counts by its lower limit (Wilson's, ``sure`` standard errors), so that a few pages can't make a
rule by chance: the limit must be ``lift`` times the share of bad pages among all, or ``most_confidence`` if
that is less. A rule blocks urls that have all its tokens. A combination of which a part is a rule too adds
nothing and is left out.

Spark's FP-growth mines the combinations. Single tokens are counted first: those that are rules, and those
with too little support, can't be part of a longer rule and leave. FP-growth lists sets of any length, a power
of two of them where many pages share many tokens. Where more than ``most_items`` tokens of some page are left,
tokens are therefore put into classes by their hash, and a page becomes one basket for each set of up to three
of its classes, of the tokens in these, marked with the set. A combination counts in the baskets of exactly
its classes, which every page that has it gives once, so the rules are the same at any width. There are as
many classes as leave at most ``most_items`` (or three) tokens in a basket. Sets of classes with too few bad
baskets for the support are left out before mining.

A rule is found through an inverted index by its rarest token, so a url looks at few rules. The index goes
to all tasks; if there are more than ``most_rules`` rules it is a table that the urls' tokens are joined with.

Results for special input: a null url, or one without ``://``, has an empty host and path and no tokens,
so it is allowed; labels of one page that differ count as bad if any is; pages without a label teach
nothing; repeated rows are judged (and, with a label, learned from) one by one. With fewer than ``least``
bad pages that share tokens there are no mined rules. Of several rules that fit, the one of fewest tokens
is named, of these the one of the highest limit, then the first in the alphabet. Urls of any length are used as a
whole. Columns host, path, rule, mined and verdict of the input are replaced, all others stay.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import arrow_column, lowered, unused, written

#: (verdict, host, beginning of the path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT, LEAST, LIFT, MOST_CONFIDENCE, SURE = 0.005, 20, 1.5, 0.9, 2.0
#: Tokens of a basket that FP-growth gets at most, and rules whose index goes to all tasks.
MOST_ITEMS, MOST_RULES = 12, 50_000
BAD = "label:bad"


def host(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lowered(F.regexp_extract(rest, "^[^/?#]*", 0))


def path(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def given(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    chosen = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, whole host, last two labels, every label, words of labels that have several, path parts, query keys.

    Numbers in the path are one token. Words of a label are parted by - or _.
    """
    labels = F.split(host, r"\.")
    known = host != ""
    parts = F.filter(F.split(lowered(path), r"[/._-]"), lambda x: x != "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), lambda x: x != "")
    one = lambda name, value, when: F.when(when, F.array(F.concat(F.lit(name), value))).otherwise(F.array().cast("array<string>"))
    last = F.element_at(labels, -1)
    words = F.flatten(F.transform(F.filter(labels, lambda x: F.regexp_like(x, F.lit("[-_]"))), lambda x: F.split(x, "[-_]")))
    words = F.filter(words, lambda x: x != "")
    every = F.concat(
        one("scheme:", lowered(F.regexp_extract(url, "^([^:/?#]*)://", 1)), known),
        one("host:", host, known),
        one("top:", last, known),
        one("domain:", F.concat(F.get(labels, F.size(labels) - 2), F.lit("."), last), known & (F.size(labels) >= 2)),
        F.when(known, F.transform(F.slice(labels, 1, F.size(labels) - 1), lambda x: F.concat(F.lit("label:"), x))).otherwise(F.array().cast("array<string>")),
        F.transform(words, lambda x: F.concat(F.lit("word:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("path:"), F.when(F.regexp_like(x, F.lit("^[0-9]+$")), F.lit("#")).otherwise(x))),
        F.transform(keys, lambda x: F.concat(F.lit("key:"), x)),
    )
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def parts(pages: DataFrame, url: str, to: str = "tokens") -> DataFrame:
    out = pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    return out.withColumn(to, tokens(F.col(url), F.col("host"), F.col("path")))


def limit(wrong: str, seen: str, sure: float) -> str:
    """Wilson's lower limit of wrong / seen, as SQL for Spark and DuckDB."""
    z = f"CAST({sure} AS DOUBLE)"
    share, n = f"(CAST({wrong} AS DOUBLE) / {seen})", f"CAST({seen} AS DOUBLE)"
    return f"(({share} + {z} * {z} / (2 * {n}) - {z} * sqrt({share} * (1 - {share}) / {n} + {z} * {z} / (4 * {n} * {n}))) / (1 + {z} * {z} / {n}))"


def _counted(sets: DataFrame, least: int, confidence: float, sure: float) -> tuple[DataFrame, DataFrame]:
    """Of rows (tokens, bad) the different token sets that are rules, and those that longer rules may have as parts."""
    seen = sets.groupBy("tokens").agg(F.count_if("bad").alias("wrong"), F.count(F.lit(1)).alias("seen")).where(F.col("wrong") >= least)
    seen = written(seen.select("tokens", F.expr(limit("wrong", "seen", sure)).alias("confidence")), "sets")
    return seen.where(F.col("confidence") >= confidence), seen.where(F.col("confidence") < confidence).select("tokens")


def _class(token: Column, classes: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(classes))


def _classes(pages: DataFrame, most_items: int) -> int:
    """The least power of two of classes of which no three hold more than ``most_items`` tokens (or three) of a page."""
    widest, n = pages.agg(F.max(F.size("tokens"))).first()[0] or 0, 1
    if widest <= most_items:
        return n
    while True:
        n *= 2
        own = pages.select(F.transform("tokens", lambda x: _class(x, n)).alias("own"))
        sizes = F.transform(F.array_distinct("own"), lambda c: F.size(F.filter("own", lambda x: x == c)))
        most = F.aggregate(F.slice(F.sort_array(sizes, asc=False), 1, 3), F.lit(0), lambda a, x: a + x)
        if own.agg(F.max(most)).first()[0] <= max(3, most_items):
            return n


def _baskets(pages: DataFrame, classes: int) -> DataFrame:
    """Rows (block, tokens, bad): a page's tokens of each set of up to three of its classes, where these are two or more."""
    own = pages.select("bad", F.transform("tokens", lambda x: F.struct(_class(x, classes).alias("c"), x.alias("t"))).alias("own"))
    out = own.withColumn("all", F.array_distinct(F.transform("own", lambda x: x["c"]))).withColumn("a", F.explode("all"))
    out = out.withColumn("b", F.explode(F.filter("all", lambda x: x >= F.col("a"))))
    out = out.withColumn("c", F.explode(F.filter("all", lambda x: F.when(F.col("a") == F.col("b"), x == F.col("a")).otherwise(x >= F.col("b")))))
    tokens = F.transform(F.filter("own", lambda x: x["c"].isin(F.col("a"), F.col("b"), F.col("c"))), lambda x: x["t"])
    block = F.concat_ws(",", F.array_distinct(F.array("a", "b", "c")).cast("array<string>"))
    return out.select(block.alias("block"), tokens.alias("tokens"), "bad").where(F.size("tokens") >= 2)


def _by_growth(pages: DataFrame, least: int, confidence: float, sure: float, most_items: int) -> DataFrame:
    """Rules (tokens, confidence) of two and three tokens by FP-growth, from rows (tokens, bad)."""
    classes = _classes(pages, most_items)
    items = F.transform("tokens", lambda x: F.concat("block", F.lit("|"), x))
    items = F.when(F.col("bad"), F.array_append(items, F.lit(BAD))).otherwise(items)
    each = written(_baskets(pages, classes), "parts")
    open_ = each.where("bad").groupBy("block").count().where(F.col("count") >= least)
    baskets = written(each.join(open_, "block", "left_semi").select(items.alias("items")), "baskets")
    n = max(1, baskets.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n)).fit(baskets)
    sets = model.freqItemsets.select(F.filter("items", lambda x: x != BAD).alias("items"), F.array_contains("items", BAD).alias("with"), "freq")
    sets = sets.where(F.size("items").between(2, 3)).withColumn("block", F.substring_index(F.get("items", 0), "|", 1))
    sets = sets.withColumn("tokens", F.sort_array(F.transform("items", lambda x: F.substr(x, F.length("block") + 2))))
    held = F.array_sort(F.array_distinct(F.transform("tokens", lambda x: _class(x, classes))))
    sets = sets.where(F.concat_ws(",", held.cast("array<string>")) == F.col("block"))
    found = sets.groupBy("tokens").agg(F.max(F.when(F.col("with"), F.col("freq"))).alias("wrong"), F.max(F.when(~F.col("with"), F.col("freq"))).alias("seen"))
    found = found.where(F.col("wrong") >= least).select("tokens", F.expr(limit("wrong", "seen", sure)).alias("confidence"))
    found = written(found.where(F.col("confidence") >= confidence), "rules")
    pairs, triples = found.where(F.size("tokens") == 2), found.where(F.size("tokens") == 3)
    return pairs.unionByName(_without(triples, pairs))


def _pairs_of(triple: str) -> Column:
    x = lambda i, j: F.array(F.get(triple, i), F.get(triple, j))
    return F.array(x(0, 1), x(0, 2), x(1, 2))


def _without(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """The triples that have none of the pairs as a part."""
    gone = triples.select("tokens", F.explode(_pairs_of("tokens")).alias("pair")).join(pairs.select(F.col("tokens").alias("pair")), "pair", "left_semi").select("tokens").distinct()
    return triples.join(gone, "tokens", "left_anti")


def mined(labelled: DataFrame, *, support: float = SUPPORT, least: int = LEAST, lift: float = LIFT, most_confidence: float = MOST_CONFIDENCE, sure: float = SURE, most_items: int = MOST_ITEMS) -> DataFrame:
    """Token combinations that mean "bad", with the lower limit of their confidence, from rows (tokens, bad)."""
    pages = written(labelled.select(F.monotonically_increasing_id().alias("page"), "tokens", "bad"), "pages")
    size = pages.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("bad").cast("double")), F.lit(0.0)).alias("share")).first()
    least = max(least, -(-int(size.n * support * 1000) // 1000))
    confidence = min(most_confidence, lift * size.share)
    each = pages.select("page", "bad", F.explode("tokens").alias("token"))
    rules, open_ = _counted(each.select("bad", F.array("token").alias("tokens")), least, confidence, sure)
    left = each.join(open_.select(F.get("tokens", 0).alias("token")), "token", "left_semi")
    left = written(left.groupBy("page", "bad").agg(F.collect_list("token").alias("tokens")), "left")
    return rules.unionByName(_by_growth(left, least, confidence, sure, most_items))


def inverted(rules: list[list[str]]) -> dict[str, list[tuple[int, frozenset]]]:
    """Rules by the token that fewest rules have."""
    n = Counter(t for own in rules for t in own)
    index: dict[str, list[tuple[int, frozenset]]] = {}
    for i, own in enumerate(rules):
        index.setdefault(min(own, key=lambda t: (n[t], t)), []).append((i, frozenset(own)))
    return index


def _hits_sent(pages: DataFrame, rules: DataFrame, tokens: str, to: str) -> DataFrame:
    """Adds the name of the first rule that fits, from an index that all tasks have."""
    found = [r.tokens for r in rules.orderBy(F.size("tokens"), F.desc("confidence"), F.array_join("tokens", " & ")).collect()]
    sent = pages.sparkSession.sparkContext.broadcast((found, inverted(found)))

    def work(rows: list) -> pa.Array:
        all_rules, index = sent.value
        out = []
        for own in rows:
            has = set(own)
            hit = min((i for t in own for i, needed in index.get(t, ()) if needed <= has), default=None)
            out.append(None if hit is None else " & ".join(all_rules[hit]))
        return pa.array(out, pa.string())

    return pages.withColumn(to, arrow_column(work, "string")(F.col(tokens)))


def _hits_joined(pages: DataFrame, rules: DataFrame, tokens: str, to: str) -> DataFrame:
    """As ``_hits_sent``, from an index that is a table."""
    each = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    rare = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = each.join(rare, "token").groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("rarest"))
    seen = pages.select(F.col(tokens).alias("own")).distinct()
    met = seen.withColumn("rarest", F.explode("own")).join(index, "rarest").where(F.size(F.array_intersect("own", "tokens")) == F.size("tokens"))
    best = F.min(F.struct(F.size("tokens").alias("n"), (-F.col("confidence")).alias("less"), F.array_join("tokens", " & ").alias("name")))
    names = met.groupBy(F.col("own").alias(tokens)).agg(best["name"].alias(to))
    return pages.join(names, tokens, "left").select(*pages.columns, to)


def judge(pages: DataFrame, labels: DataFrame, *, page: str = "page_id", url: str = "url", rules=RULES, most_rules: int = MOST_RULES, **mining) -> DataFrame:
    """Adds host, path, the given rule, the mined rule and the verdict. ``labels`` has (page, bad)."""
    seen = parts(pages.select(F.col(page).alias("page"), F.col(url).alias("url")), "url").select("page", "tokens")
    known = labels.where(F.col("bad").isNotNull()).groupBy(F.col(page).alias("page")).agg(F.max("bad").alias("bad"))
    found = written(mined(seen.join(known, "page").where(F.size("tokens") > 0).select("tokens", "bad"), **mining), "rules")
    rest = pages.drop("host", "path", "rule", "verdict", "mined")
    own, given_ = unused(rest, "tokens"), unused(rest, "given")
    hits = _hits_sent if found.count() <= most_rules else _hits_joined
    out = hits(parts(rest, url, own), found, own, "mined").withColumn(given_, given(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col(given_)["verdict"], F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.withColumn("rule", F.col(given_)["rule"]).withColumn("verdict", verdict).drop(given_, own)


#: The number of the document that a page holds stands at the end of its path.
NUMBER = r"/([0-9]+)(?:\.html)?/?$"


def oracle() -> str:
    """The query in DuckDB's SQL: all combinations of up to three tokens are counted."""
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    case = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " + "{" + f"'rule': '{h}{p}', 'verdict': '{v}'" + "}" for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])))
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(url, '') AS url, {low("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, string_split(host, '.') AS l FROM h),
t AS (SELECT page_id, host, path, CASE WHEN host = '' THEN [] ELSE list_distinct(list_concat(
  ['scheme:' || {low("regexp_extract(url, '^([^:/?#]*)://', 1)")}, 'host:' || host, 'top:' || l[-1]],
  CASE WHEN len(l) >= 2 THEN ['domain:' || l[-2] || '.' || l[-1]] ELSE [] END,
  list_transform(l[1:len(l) - 1], lambda x: 'label:' || x),
  list_transform(list_filter(flatten(list_transform(list_filter(l, lambda x: regexp_matches(x, '[-_]')), lambda x: string_split_regex(x, '[-_]'))), lambda x: x <> ''), lambda x: 'word:' || x),
  list_transform(list_filter(string_split_regex({low("path")}, '[/._-]'), lambda x: x <> ''), lambda x: 'path:' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' ELSE x END),
  list_transform(list_filter(list_transform(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^[^=]*')), lambda x: x <> ''), lambda x: 'key:' || x))) END AS tokens FROM s),
lab AS (SELECT page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM t JOIN labels ON doc_id = try_cast(regexp_extract(path, '{NUMBER}', 1) AS BIGINT) WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY page_id),
k AS (SELECT row_number() OVER () AS id, tokens, bad FROM t JOIN lab USING (page_id) WHERE len(tokens) > 0),
e AS (SELECT id, bad, unnest(tokens) AS tok FROM k),
c AS (SELECT id, bad, [tok] AS c FROM e
  UNION ALL SELECT a.id, a.bad, [a.tok, b.tok] FROM e a JOIN e b ON a.id = b.id AND a.tok < b.tok
  UNION ALL SELECT a.id, a.bad, [a.tok, b.tok, d.tok] FROM e a JOIN e b ON a.id = b.id AND a.tok < b.tok JOIN e d ON d.id = a.id AND b.tok < d.tok),
m AS (SELECT c FROM c GROUP BY c HAVING sum(bad) >= greatest({LEAST}, ceil((SELECT count(*) FROM k) * {SUPPORT}))
  AND {limit("sum(bad)", "count(*)", SURE)} >= least({MOST_CONFIDENCE}::DOUBLE, {LIFT}::DOUBLE * (SELECT avg(bad) FROM k))),
g AS (SELECT page_id, host, path, tokens, CASE {case} END AS g FROM t)
SELECT page_id, host, path, g.rule AS rule,
  coalesce(g.verdict, CASE WHEN EXISTS (SELECT 1 FROM m WHERE list_has_all(g_.tokens, m.c)) THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT page_id, host, path, tokens, g FROM g) g_"""
