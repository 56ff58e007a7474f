"""The rules and the small labelled URL table of the URL filter's query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))

#: Hosts labelled by hand. Gambling, pills, adult pages, link farms and trackers are blocked.
BLOCKED = ("casino-royal casino-online big-casino lucky-win win-money jackpot-win poker-stars-bonus free-poker "
           "free-spins best-bets sports-bets betting-tips online-pills pills-shop cheap-meds cheap-viagra "
           "cheap-watches adult-videos adult-cams adult-dating hot-adult xxx-tube sexy-x spam-links spam-mail "
           "link-farm content-farm seo-farm ads-server ads-click track-pixel click-track free-prizes free-loans "
           "payday-loans crypto-win").split()
ALLOWED = ("news daily weather museum library university physics history theatre others therapy thread thesis "
           "that then this than these there thought thunder nation station motion tion ththe thened thnon therly "
           "ander under garden kitchen recipes travel football science python docs forum health school council "
           "parliament archive journal gazette market street climate astronomy translation education").split()
PREFIXES = ("", "www.", "blog.", "m.")
ENDINGS = (".example.com", ".example.net", ".example.org")
PATHS = ("/en/%d", "/fr/%d.html", "/de/%d/", "/es/%d", "/en/%d.html#top", "/de/%d?page=2", "/fr/%d/", "/es/%d.html", "/en/%d/", "")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): every host under several prefixes, endings and paths, dealt alike to both labels."""
    names = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(i).alias("i"), F.lit(name).alias("name"))
                                for label, hosts in (("block", BLOCKED), ("allow", ALLOWED))
                                for i, name in enumerate(hosts)]))
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int"))
    rows = spark.range(0, 6, 1, 1).withColumn("host", names).select("id", "host.*")
    at = F.col("i") + F.col("id")
    path = F.replace(pick(PATHS, F.col("i") + F.col("id") * 3), F.lit("%d"), F.pmod(at * 137 + 11, F.lit(997)).cast("string"))
    return rows.select(F.concat(F.lit("https://"), pick(PREFIXES, at), F.col("name"), pick(ENDINGS, F.col("i") + F.col("id") * 2), path)
                       .alias("url"), "label")
