"""URL filters: rules on hosts and paths, and for other URLs the ratio of two character language models.

Both models are smoothed variable-order Markov models, one of the URLs that rules accept and one of those that they
reject. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import stored, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
# Characters before a character that the models look at, at most.
ORDER = 4
# Weight of the next shorter context, in characters seen.
SMOOTHING = 2.0
# Probability of a character without any context.
UNIFORM = 1 / 256
# A gram with more than 1 / HOT of all positions is joined by broadcast: fewer than HOT rows.
HOT = 4096
# Scores beyond are counted at this bound while the threshold is sought: at most twice so many rows.
CLIP = 10000
# Leading hex digits of a URL's MD5 that keep it out of the counts, for the threshold: 3 in 16.
HELD = "012"
BEGIN, END = "char(2)", "char(3)"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, host, path, rule, given) of every row; `given` is the verdict of the longest rule that fits, else null.

    The host lies between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; the path from there to `?`, `#`
    or the end. Null, and a URL without `://`, have an empty host and path and fit no rule. `rules` are (verdict, host
    with path) as written by hand; each row looks at all of them. Repeated rows stay.
    """
    if not all("/" in r for _, r in rules):
        raise ValueError("a rule is a host followed by a path that begins with /")
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r))
    structs = [f"named_struct('rule', {_quoted(r)}, 'host', {_quoted(r[: r.index('/')])}, 'path', {_quoted(r[r.index('/'):])}, 'given', {_quoted(v)})" for v, r in ordered]
    parts = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).selectExpr(
        "key", "url", "case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest").selectExpr(
        "key", "url", "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host",
        "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path")
    if not structs:
        return parts.selectExpr("*", "cast(null as string) as rule", "cast(null as string) as given")
    fits = "(host = r.host or endswith(host, concat('.', r.host))) and startswith(path, r.path)"
    return parts.withColumn("fit", F.expr(f"get(filter(array({', '.join(structs)}), r -> {fits}), 0)")).selectExpr(
        "key", "url", "host", "path", "fit.rule as rule", "fit.given as given")


def positions(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """The columns of `urls` without the URL, and `gram`: one row for each character and the end, with the `order` characters before it."""
    chars = f"split(concat(repeat({BEGIN}, {order}), coalesce(url, ''), {END}), '')"
    grams = f"transform(sequence(1, size(chars) - {order}), i -> array_join(slice(chars, i, {order + 1}), ''))"
    return urls.withColumn("chars", F.expr(chars)).withColumn("gram", F.explode(F.expr(grams))).drop("chars", "url")


def gram_weights(labelled: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING) -> DataFrame:
    """(gram, n, weight) of every gram of `labelled` (url, accepted, rejected: 0 or 1, whether a row counts for a model).

    `weight` is floor(1000 ln) of the gram's last character's probability after the others in the model of accepted
    URLs over that in the model of rejected ones. The probability after a context mixes its counts with `smoothing`
    times the probability after the context without its first character, down to the uniform one: a context that was
    never seen leaves all to the next shorter. Counts of every row are gathered, combined before the shuffle.
    """
    grams = stored(positions(labelled, order).groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"), F.count("*").alias("n")))
    below = None
    for size in range(1, order + 2):
        met = grams.groupBy(F.expr(f"right(gram, {size})").alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("context", F.expr(f"left(g, {size - 1})"))
        after = met.groupBy("context").agg(F.sum("a").alias("of_a"), F.sum("r").alias("of_r"))
        both = met.join(after, "context")
        if below is None:
            both = both.selectExpr("*", f"{UNIFORM!r}D as low_a", f"{UNIFORM!r}D as low_r")
        else:
            both = both.withColumn("suffix", F.expr(f"right(g, {size - 1})")).join(below.selectExpr("g as suffix", "p_a as low_a", "p_r as low_r"), "suffix")
        below = both.selectExpr("g", f"(a + {smoothing!r}D * low_a) / (of_a + {smoothing!r}D) as p_a", f"(r + {smoothing!r}D * low_r) / (of_r + {smoothing!r}D) as p_r")
    return stored(grams.join(below.withColumnRenamed("g", "gram"), "gram").selectExpr("gram", "n", "floor(1000 * ln(p_a / p_r)) as weight"))


def likelihoods(urls: DataFrame, weights: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """(row, score): floor of the mean weight of a URL's grams, its end counted as one, for each `row` of `urls`.

    Frequent grams (fewer than `hot` of them) meet the positions by broadcast, others by a shuffle in which none has more
    than one position in `hot`.
    """
    total = weights.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(weights.where(F.col("n") * hot > total).select("gram", "weight"))
    seldom = weights.where(F.col("n") * hot <= total).select("gram", "weight")
    at = positions(urls.select("row", "url"), order)
    met = at.join(often, "gram").unionByName(at.join(often, "gram", "left_anti").join(seldom, "gram")).select("row", "weight")
    return met.groupBy("row").agg(F.expr("floor(sum(weight) / count(*))").alias("score"))


def threshold(scored: DataFrame, clip: int = CLIP) -> DataFrame:
    """One row, `least`: the score from which on accepting has the best mean of the shares of accepted and rejected rows judged right.

    `scored` has (score, given). Between two scores that occur the one nearest to 0 stands for all; ties go to the least
    magnitude, then to the larger score; 0 where either kind is missing.
    At most 2 * clip + 1 counts meet in one task.
    """
    counts = scored.where("given is not null").groupBy(F.expr(f"greatest(least(score, {clip}L), {-clip}L)").alias("v")).agg(
        F.expr("count_if(given = 'allow')").alias("a"), F.expr("count_if(given = 'block')").alias("b"))
    rates = counts.selectExpr("v", "sum(a) over () as all_a", "sum(b) over () as all_b", "sum(a) over (order by v desc) as right_a", "sum(b) over (order by v) - b as right_b",
                              "least(v, greatest(0L, coalesce(lag(v) over (order by v) + 1, 0L))) as at")
    right = rates.where("all_a > 0 and all_b > 0").selectExpr("at", "right_a / all_a + right_b / all_b as share")
    return right.agg(F.expr("max_by(at, struct(share, -abs(at) as near, at))").alias("at")).selectExpr("coalesce(at, 0L) as least")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url", order: int = ORDER,
          smoothing: float = SMOOTHING) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row: the rule's verdict where one fits, else that of the models.

    The models count all URLs that a rule judges, but those of the held-out hash range, by which the threshold is set.
    `score` is the mean log ratio per character in thousandths, rounded down; a row with as much as the threshold is
    allowed. A null URL is scored like an empty one. Where rules judge nothing, all ratios are 0 and everything is
    allowed. Repeated rows and null keys stay, one result each; a repeated URL counts each time. An empty table gives
    no rows. Other columns are not read, whatever their names. No row holds more than one URL's characters.
    """
    held = F.expr(f"coalesce(substring(md5(url), 1, 1) in ({', '.join(repr(d) for d in HELD)}), false)")
    rows = stored(ruled(pages, rules, key, url).withColumn("held", held).withColumn("row", F.monotonically_increasing_id()))
    counted = rows.selectExpr("url", "int(coalesce(given = 'allow' and not held, false)) as accepted", "int(coalesce(given = 'block' and not held, false)) as rejected")
    scores = stored(rows.join(likelihoods(rows, gram_weights(counted, order, smoothing), order), "row"))
    least = threshold(scores.where("held").select("score", "given"))
    return scores.crossJoin(F.broadcast(least)).selectExpr(
        "key", "host", "path", "rule", "coalesce(given, case when score >= least then 'allow' else 'block' end) as verdict", "score").withColumnRenamed("key", key)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
