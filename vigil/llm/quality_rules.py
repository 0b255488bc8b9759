"""Quality rules with risk-controlled thresholds (operator 6), in DataFrame functions alone.

Every document gets integer measures of its whole text. A rule rejects a document whose measure, a
ratio in thousandths, is above a cutoff from a fixed grid. Cutoffs are chosen per stratum from labelled
documents, of which a quarter, by the hash of the id, proposes and the others, the holdout, decide:

1. The first part gives for each rule one cutoff at each of five budgets, from strict to generous: the one
   of the best gain (bad documents caught less ``PRICE`` times good ones lost, the loosest at a tie) among
   those that lose at most that share of the good documents. So the documents that all rules together
   reject at one budget are among those that they reject at the next.
2. On the holdout, the exact binomial test asks of all rules together, budget after budget, whether they
   discard more than ``risk`` of the good documents. As the first test that doesn't reject this ends the
   sequence, the tests of a stratum need no correction; the level is divided by the number of strata that
   have enough good documents for any test to succeed (others can't give a wrong result).
3. Of the budgets that passed, the one of the best gain on the holdout is used.

So with probability 1 - ``level`` no stratum loses more than ``risk`` of its good documents to the rules. A
stratum with too few labels for any test keeps all its documents.

Results for special input: a null or empty text has measures of 0; a null stratum is one with the empty
string; a document without a label counts for no cutoff; of several labels of a document the highest
counts; repeated rows are measured one by one, and each counts for the cutoffs. Measures of long texts are
taken of the whole. Columns of the input with the names of measures or results are replaced, all others
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import SPACES, UPPER, unused, written

SEPARATOR = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rule: (counted measure, measure that it is a share of).
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Cutoffs in thousandths, fixed before any label is seen.
GRID = (5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900, 1000, 1500)
RISK, LEVEL, PRICE = 0.02, 0.05, 20
#: Thousandths of the good documents that each rule may lose, by which cutoffs are proposed.
BUDGETS = (0, 2, 5, 10, 20)
#: First characters of the ids' md5 of the documents that propose.
PROPOSING = ("0", "1", "2", "3")


def _without(col: Column, chars: str) -> Column:
    return F.translate(col, chars, "")


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Windows are sorted with their positions, so equal ones are neighbours. Texts whose windows are all
    different, which a hash set tells, aren't sorted.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def positions(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        same = lambda i, j: F.coalesce(F.get(s, i)["w"] == F.get(s, j)["w"], F.lit(False))
        return F.transform(F.filter(at, lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(s, i)["i"])

    def covered(p: Column) -> Column:
        return F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2))))

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_let(_let(ordered, positions), covered))

    return F.when(F.size(words) < 4, 0).otherwise(_let(windows, count))


def measures(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with the measures instead of the text."""
    own, words, lines = (unused(docs, n) for n in ("own_text", "own_words", "own_lines"))
    out = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(words, F.array_remove(F.split(own, SEPARATOR), "")).withColumn(lines, F.filter(F.split(F.col(own), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    of = lambda chars: F.length(own) - F.length(_without(F.col(own), chars))
    counted = {
        "n_words": F.size(words),
        "word_chars": F.length(_without(F.col(own), SPACES)),
        "n_symbols": of(SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(F.col(words)),
        "n_upper": of(UPPER),
        "n_marks": of("!?"),
    }
    kept = [c for c in docs.columns if c.lower() not in counted and c != text]
    return out.select(*kept, *(v.cast("long").alias(k) for k, v in counted.items()))


def share(rule: str) -> Column:
    """The rule's measure in whole thousandths."""
    part, whole = RULES[rule]
    return F.floor(F.col(part) * 1000 / F.greatest(F.col(whole), F.lit(1))).cast("long")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial variable, exactly summed in logarithms."""
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    return F.exp(F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, add)["total"])


def _gain(caught: str, lost: str) -> Column:
    return F.col(caught) - PRICE * F.col(lost)


def proposals(known: DataFrame) -> DataFrame:
    """Cutoffs (stratum, budget, rule, cutoff) from rows (stratum, good, measures); ``budget`` is its number."""
    grid = F.array(*map(F.lit, GRID))
    above = lambda m: F.size(F.filter(grid, lambda c: c < m))
    passed = F.array(*(F.struct(F.lit(r).alias("rule"), above(share(r)).alias("above")) for r in RULES))
    counted = known.select("stratum", "good", F.explode(passed).alias("x")).groupBy("stratum", "x.rule", "x.above").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    size = counted.groupBy("stratum").agg((F.sum("good") / len(RULES)).cast("long").alias("n"))
    at = counted.where("above > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("above") - 1))).groupBy("stratum", "rule", "j").agg(F.sum("good").alias("lost"), F.sum("bad").alias("caught"))
    each = at.join(size, "stratum").where(_gain("caught", "lost") > 0).withColumn("budget", F.explode(F.sequence(F.lit(0), F.lit(len(BUDGETS) - 1))))
    allowed = each.where(1000 * F.col("lost") <= F.get(F.array(*map(F.lit, BUDGETS)), F.col("budget")) * F.col("n"))
    best = allowed.groupBy("stratum", "budget", "rule").agg(F.max_by("j", F.struct(_gain("caught", "lost"), F.col("j"))).alias("j"))
    return best.select("stratum", "budget", "rule", F.get(grid, F.col("j")).alias("cutoff"))


def _by_rule(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each of the keys with a column for each rule's cutoff, null if it has none."""
    return chosen.groupBy(*keys).agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cutoff_{r}") for r in RULES))


def cutoffs(measured: DataFrame, labels: DataFrame, *, key: str, stratum: str, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum and rule with a usable cutoff: stratum, rule, cutoff."""
    label = labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max("quality") == 1).alias("good"))
    own = measured.select(F.col(key).alias("key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), *sorted({x for pair in RULES.values() for x in pair}))
    known = written(own.join(label, "key").withColumn("proposes", F.substring(F.md5(F.col("key").cast("string").cast("binary")), 1, 1).isin(*PROPOSING)), "known")
    proposed = written(proposals(known.where("proposes")), "proposals")
    held = known.where("NOT proposes")
    size = held.where("good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    testable = size.where(F.pow(F.lit(1 - risk), F.col("n")) <= level).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    hit = F.coalesce(F.greatest(*((share(r) > F.col(f"cutoff_{r}")) for r in RULES)), F.lit(False))
    tried = held.join(_by_rule(proposed, ["stratum", "budget"]), "stratum").where(hit)
    lost = tried.groupBy("stratum", "budget").agg(F.count_if("good").alias("lost"), F.count_if(~F.col("good")).alias("caught"))
    # a budget whose cutoffs reject nothing of the holdout has no row there
    lost = proposed.select("stratum", "budget").distinct().join(lost, ["stratum", "budget"], "left").fillna(0, ["lost", "caught"])
    tested = lost.join(size, "stratum").join(F.broadcast(testable))  # one row
    fits = F.col("lost") < F.col("n") * F.lit(risk)
    tail = binomial_tail(F.when(fits, F.col("lost")).otherwise(F.lit(0)).cast("long"), F.col("n"), risk)
    good = tested.withColumn("passes", fits & (tail <= F.lit(level) / F.col("strata")))
    in_order = Window.partitionBy("stratum").orderBy("budget")
    good = good.withColumn("passes", F.bool_and("passes").over(in_order)).where(F.col("passes") & (_gain("caught", "lost") > 0))
    best = good.groupBy("stratum").agg(F.min_by("budget", F.struct(-_gain("caught", "lost"), F.col("budget"))).alias("budget"))
    return proposed.join(best, ["stratum", "budget"], "left_semi").select("stratum", "rule", "cutoff")


def judged(measured: DataFrame, chosen: DataFrame, *, stratum: str) -> DataFrame:
    """The measured documents with ``rejected_by``, the rules that reject each.

    The cutoffs, a row per stratum, are written down, so that Spark knows their size and sends them to all
    tasks only while they are few.
    """
    table = _by_rule(chosen, ["stratum"])
    own, names = unused(measured, "stratum"), {r: unused(measured, f"cutoff_{r}") for r in RULES}
    table = written(table.select(F.col("stratum").alias(own), *(F.col(f"cutoff_{r}").alias(n) for r, n in names.items())), "cutoffs")
    kept = [c for c in measured.columns if c.lower() != "rejected_by"]
    out = measured.select(*kept, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias(own)).join(table, own, "left")
    hits = F.array_compact(F.array(*(F.when(share(r) > F.col(n), F.lit(r)) for r, n in names.items())))
    return out.select(*kept, hits.alias("rejected_by"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def keep(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """One row per document: key, stratum, measures, the rules that reject it and ``kept``."""
    measured = written(measures(docs.select(key, stratum, text), text=text), "measures")
    out = judged(measured, cutoffs(measured, labels, key=key, stratum=stratum), stratum=stratum)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def oracle() -> str:
    """The query in DuckDB's SQL."""
    shares = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, 1000 * {a} // greatest({b}, 1) AS m FROM measured" for r, (a, b) in RULES.items())
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS lines FROM t),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS o(o) GROUP BY doc_id),
measured AS (SELECT w.doc_id, stratum, len(words) AS n_words,
  length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  length(t) - length(translate(t, '{UPPER}', '')) AS n_upper, length(t) - length(translate(t, '!?', '')) AS n_marks
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
shares AS ({shares}),
lab AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
known AS (SELECT s.*, q, substr(md5(doc_id::VARCHAR), 1, 1) IN ({", ".join(f"'{x}'" for x in PROPOSING)}) AS proposes FROM shares s JOIN lab USING (doc_id)),
grid AS (SELECT unnest([{", ".join(map(str, GRID))}]) AS cutoff),
budgets AS (SELECT unnest([{", ".join(map(str, BUDGETS))}]) AS share, unnest(range({len(BUDGETS)})) AS budget),
psize AS (SELECT stratum, count(*) FILTER (q = 1) // {len(RULES)} AS n FROM known WHERE proposes GROUP BY stratum),
tuned AS (SELECT stratum, rule, cutoff, count(*) FILTER (q = 1) AS k, count(*) FILTER (q <> 1) AS c FROM known, grid WHERE proposes AND m > cutoff GROUP BY ALL),
picks AS (SELECT stratum, budget, rule, arg_max(cutoff, struct_pack(gain := c - {PRICE} * k, cutoff := cutoff)) AS cutoff
  FROM tuned JOIN psize USING (stratum), budgets WHERE 1000 * k <= share * n AND c - {PRICE} * k > 0 GROUP BY ALL),
sizes AS (SELECT stratum, count(*) // {len(RULES)} AS n FROM known WHERE NOT proposes AND q = 1 GROUP BY stratum),
strata AS (SELECT greatest(1, count(*)) AS strata FROM sizes WHERE pow(1 - {RISK}::DOUBLE, n) <= {LEVEL}::DOUBLE),
held AS (SELECT stratum, budget, doc_id, q, bool_or(m > cutoff) AS hit FROM known JOIN picks USING (stratum, rule) WHERE NOT proposes GROUP BY ALL),
tried AS (SELECT stratum, budget, count(*) FILTER (hit AND q = 1) AS k, count(*) FILTER (hit AND q <> 1) AS c FROM held GROUP BY ALL),
tails AS (SELECT stratum, budget, any_value(k) AS k, any_value(c) AS c, any_value(n) AS n, any_value(strata) AS strata,
  sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}::DOUBLE) + (n - i) * ln(1 - {RISK}::DOUBLE))) AS tail
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM tried JOIN sizes USING (stratum), strata) GROUP BY stratum, budget),
passed AS (SELECT *, bool_and(k < n * {RISK}::DOUBLE AND tail <= {LEVEL}::DOUBLE / strata) OVER (PARTITION BY stratum ORDER BY budget) AS good FROM tails),
chosen AS (SELECT stratum, arg_min(budget, struct_pack(loss := {PRICE} * k - c, budget := budget)) AS budget FROM passed WHERE good AND c - {PRICE} * k > 0 GROUP BY stratum),
best AS (SELECT stratum, rule, cutoff FROM picks JOIN chosen USING (stratum, budget)),
hit AS (SELECT DISTINCT doc_id FROM shares JOIN best USING (stratum, rule) WHERE m > best.cutoff)
SELECT m.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND hit.doc_id IS NULL AS kept
FROM measured m LEFT JOIN hit ON m.doc_id = hit.doc_id"""
