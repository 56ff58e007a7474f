"""URL filters: a few host and path rules, and logistic regression on hashed n-grams for all other URLs.

Everything is a DataFrame expression: n-grams are hashed in place, the model is trained by full gradient
steps that Spark aggregates, and scoring reads each URL once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Gradients are summed as integers of this many parts of one, so that their sums do not depend on order.
PARTS = float(2 ** 40)


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]], pick: int) -> Column:
    """Of the longest rule that fits: its verdict (``pick`` 0) or the rule itself (1); null where none does.

    A rule is (verdict, host and path). It fits its host and all subdomains where the path starts with its
    own. Of equally long rules the longer host wins, then the earlier rule.
    """
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), len(_split_rule(r[1])[0])), reverse=True)[::-1]:
        its_host, its_path = _split_rule(rule[1])
        at_host = (host == its_host) | F.endswith(host, F.lit("." + its_host))
        chosen = F.when(at_host & F.startswith(path, F.lit(its_path)), F.lit(rule[pick])).otherwise(chosen)
    return chosen


def hashed_grams(host: Column, path: Column, sizes: Sequence[int], buckets: int) -> Column:
    """The distinct buckets (1 and up) of the n-grams of host and path; bucket 0 is left for the bias.

    Host and path have marks at both ends and name spaces of their own. Characters are split off once, so
    the work grows with the length of the URL.
    """
    def grams(text: Column, space: str, size: int) -> Column:
        chars = F.split(F.concat(F.lit("\x02"), text, F.lit("\x03")), "")
        # The characters are bound once, as the only element of an array, and not split again for each n-gram.
        return F.flatten(F.transform(F.array(chars), lambda c: F.transform(
            F.when(F.size(c) >= size, F.sequence(F.lit(0), F.size(c) - size)),
            lambda i: F.xxhash64(F.lit(space), *[F.get(c, i + k) for k in range(size)]))))

    parts = [F.coalesce(grams(text, space, size), F.array().cast("array<bigint>"))
             for text, space in ((host, "h"), (path, "p")) for size in sizes]
    hashes = F.concat(*parts)
    return F.array_distinct(F.transform(hashes, lambda h: (F.pmod(h, F.lit(buckets - 1)) + 1).cast("int")))


def _constant(weights: Sequence[float]) -> Column:
    """The weights as one constant array, which the optimizer folds into a literal."""
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def _logit(grams: Column, weights: Column) -> Column:
    """Bias and mean-scaled sum of weights; the n-grams of one URL form a vector of length one."""
    total = F.aggregate(grams, F.lit(0.0), lambda so_far, bucket: so_far + F.get(weights, bucket))
    return F.get(weights, F.lit(0)) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def train(labelled: DataFrame, *, sizes: Sequence[int] = (3, 4), buckets: int = 2 ** 14, rounds: int = 30,
          rate: float = 4.0, decay: float = 1e-4, momentum: float = 0.9, most: int = 10_000) -> list[float]:
    """The weight of each bucket; bucket 0 is the bias, and a positive logit means block.

    ``labelled`` has url and label (``allow`` or ``block``). It is meant to be small: the ``most`` rows of
    smallest hash take part, repeated rows once; rows without a URL or with another label take none. Both
    labels weigh the same in total. Each round is one stored step of full gradient with Nesterov's
    momentum: its weights are one row, which the next round reads as a scalar subquery. Sums are of
    integers, so reruns give the same model. Without labelled rows all weights are 0.
    """
    rows = (labelled.select("url", "label").where("url IS NOT NULL AND label IN ('allow', 'block')").distinct()
            .orderBy(F.xxhash64("url", "label"), "url", "label").limit(most))
    grams = hashed_grams(host_of(F.col("url")), path_of(F.col("url")), sizes, buckets)
    rows = stored(rows.select((F.col("label") == "block").cast("int").alias("y"), grams.alias("grams")), "url_labelled")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [0.0] * buckets
    share = F.when(F.col("y") == 1, 1 / (2 * counts.get(1, 1))).otherwise(1 / (2 * counts.get(0, 1)))
    zeros = F.array_repeat(F.lit(0.0), buckets)
    state = labelled.sparkSession.range(0, 1, 1, 1).select(zeros.alias("ahead"), zeros.alias("last"))
    for _ in range(rounds):
        at = rows.withColumn("ahead", state.select("ahead").scalar())
        residual = 1 / (1 + F.exp(-_logit(F.col("grams"), F.col("ahead")))) - F.col("y")
        scale = 1 / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double"))
        entries = at.select((residual * share).alias("r"), scale.alias("scale"),
                            F.explode(F.concat(F.array(F.lit(0)), F.col("grams"))).alias("bucket"))
        part = F.when(F.col("bucket") == 0, F.col("r")).otherwise(F.col("r") * F.col("scale"))
        gradient = entries.groupBy("bucket").agg(F.sum(F.round(part * PARTS).cast("bigint")).alias("g"))
        # As many rows as buckets, whatever the tables' size.
        old = state.select(F.posexplode(F.arrays_zip("ahead", "last")).alias("bucket", "w")).select("bucket", "w.*")
        moved = old.join(gradient, "bucket", "left").select("bucket", "last", (
            F.col("ahead") - rate * (F.coalesce("g", F.lit(0)) / PARTS + decay * F.col("ahead"))).alias("moved"))
        ordered = F.array_sort(F.collect_list(F.struct("bucket", "moved", (
            F.col("moved") + momentum * (F.col("moved") - F.col("last"))).alias("ahead")))).alias("w")
        state = stored(moved.agg(ordered).select(F.col("w.ahead").alias("ahead"), F.col("w.moved").alias("last")), "url_weights")
    return state.first()["last"]


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = (), *,
               url_column: str = "url", id_column: str = "page_id", sizes: Sequence[int] = (3, 4),
               buckets: int = 2 ** 14, **training) -> DataFrame:
    """Host, path, rule, logit and verdict (allow or block) of every URL.

    A rule's verdict stands; where none fits, the model blocks URLs of positive logit and allows others.
    A null URL or one without ``://`` has an empty host and path and is judged as such; a very long URL is
    read whole; repeated rows stay repeated; an empty table gives no rows; without labelled rows the logit
    is 0 and the verdict allow. Other columns are not read. Returns page_id, host, path, rule, logit, verdict.
    """
    weights = _constant(train(labelled, sizes=sizes, buckets=buckets, **training))
    split = pages.select(F.col(id_column).alias("page_id"), F.coalesce(host_of(F.col(url_column)), F.lit("")).alias("host"),
                         F.coalesce(path_of(F.col(url_column)), F.lit("")).alias("path"))
    host, path = F.col("host"), F.col("path")
    scored = (split.withColumn("grams", hashed_grams(host, path, sizes, buckets))
              .withColumn("logit", _logit(F.col("grams"), weights)))
    by_model = F.when(F.col("logit") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule_column(host, path, rules, 1).alias("rule"), "logit",
                         F.coalesce(rule_column(host, path, rules, 0), by_model).alias("verdict"))
