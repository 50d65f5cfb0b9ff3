"""URL filter by logistic regression on hashed character n-grams (operator 6, native).

Host and path are cut into character n-grams, each hashed to a weight's place. The weights are fitted from a small
labelled URL table by full-batch gradient descent with momentum, written as one SQL aggregate over the table's feature
arrays, so the whole operator is DataFrame functions. Rules on hosts and path prefixes come first.

The labelled table is made of ordinary English words of unwanted and of wanted sites, put into hosts and paths of several
shapes under many top-level domains; a fifth of its unwanted urls have the word in the path alone, and a third of the wanted
ones are under invented names, which say nothing.

Defined results: a null url, or one without `://`, has empty host and path, which the model judges by its constant and so
allows; repeated rows give repeated results, and an empty table none. Of a labelled table of more than `MOST_LABELLED` rows
those with the least hashes of their url are learned. Columns other than the key and the url are never read.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm._common import materialise, table

PLACES = 1 << 13
GRAM_LENGTHS = (3, 4, 5)
STEPS = 100
RATE = 20.0
MOMENTUM = 0.9
DECAY = 0.0001
#: An unwanted url counts so much more than a wanted one.
BALANCE = 1.5
THRESHOLD = 0.5
#: The labelled table may have so many rows, since its features are one row of the fit.
MOST_LABELLED = 5_000

#: (verdict, host, path): a rule fits its host, all its subdomains, and paths that start with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Words that mark a url as unwanted: gambling, adult content, medicines and loans, fraud, advertising.
UNWANTED = tuple("bet bets betting adult casino poker roulette jackpot slots gambling bookie lottery bingo porn sex xxx nude escort hentai camgirls erotic viagra cialis pharmacy pills steroids weightloss payday loans forex replica warez crack keygen torrent malware phishing scam spam clickbait adserver ads adtrack tracker popunder banner-ads hookup".split())
#: Words of other sites.
WANTED = tuple("news weather library museum university school garden kitchen recipes history science travel music health forum journal theatre books market village hospital council city sports football cycling railway airport hotel restaurant bakery coffee chocolate farm forest river mountain ocean island bridge castle church college institute academy research physics chemistry biology engineering software computer network database cloud photo film cinema gallery art design furniture fashion shoes insurance bank finance economy business office career training language dictionary wiki blog magazine newspaper radio podcast video game chess children family wedding holiday festival concert opera dance fitness swimming tennis golf climbing camping dog cat bird zoo plants flowers trees bread cheese pasta soup cookies tea water energy solar wind car bike bus train ship map guide ticket house apartment construction tools paper logistics mail phone internet privacy law court police charity community politics parliament culture heritage archive statistics report".split())
#: Words that stand beside either kind.
BESIDE = tuple("online best top my the world new free 24 365 pro plus zone hub now big red star land house x win cheap vip royal lucky hot super max web site".split())
WANTED_ENDS = tuple("com org net edu gov de fr es it co.uk info io museum nl eu".split())
UNWANTED_ENDS = tuple("com net org info biz xyz top club ru io de co.uk fr es".split())
FRONTS = ("", "www.", "m.", "blog.", "shop.", "en.")
UNWANTED_URLS, WANTED_URLS = 600, 1_200


def parts(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty if there is no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def places(host: Column, path: Column) -> Column:
    """The places of the n-grams of host, framed by ^ and $, and of path; repeats included."""

    def grams(text: Column, mark: str, n: int) -> Column:
        def cut(letters: Column) -> Column:
            at = F.sequence(F.lit(1), F.greatest(F.size(letters) - n + 1, F.lit(1)))
            return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.array_join(F.slice(letters, i, n), "")), F.lit(PLACES)).cast("int"))

        return let(F.split(text, ""), cut)

    return F.concat(*[grams(F.concat(F.lit("^"), text, F.lit("$")), mark, n) for text, mark in ((host, "h"), (path, "p")) for n in GRAM_LENGTHS])


def logit(weights: Column, at: Column) -> Column:
    """The weights' sum over the places, by the root of their number, and the constant in the last place."""
    total = F.aggregate(at, F.lit(0.0), lambda s, k: s + F.get(weights, k))
    return total / F.sqrt(F.size(at).cast("double")) + F.get(weights, F.lit(PLACES))


def fit(labelled: DataFrame) -> DataFrame:
    """One row, column w: array<double> of weights, the constant last, from (url string, blocked int).

    `rows` holds each url's places, `of` each place's urls; one step of gradient descent is a function of the weights and
    their momentum over both."""
    host, path = parts(F.col("url"))
    some = labelled.select("url", "blocked").orderBy(F.xxhash64("url"), "url", "blocked").limit(MOST_LABELLED)
    rows = some.select("url", F.col("blocked").cast("double").alias("y"), places(host, path).alias("at"))
    rows = rows.select((F.row_number().over(Window.orderBy("url", "y")) - 1).alias("i"), "y", "at")
    packed = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("i", "y", "at"))).alias("rows"))
    by_place = rows.select("i", F.explode("at").alias("k")).groupBy("k").agg(F.sort_array(F.collect_list("i")).alias("of"))
    every = labelled.sparkSession.range(PLACES).select(F.col("id").cast("int").alias("k")).join(by_place, "k", "left")
    every = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("of", F.array().cast("array<int>")).alias("of")))).alias("places"))
    both = packed.select("rows", every.select("places").scalar().alias("places"))
    n = F.greatest(F.size("rows"), F.lit(1)).cast("double")

    def step(state: Column) -> Column:
        w, v = state["w"], state["v"]

        def error(r: Column) -> Column:
            return (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(w, r["at"]))) - r["y"]) / n * F.when(r["y"] == 1, F.lit(BALANCE)).otherwise(F.lit(1.0))

        def moved(wrong: Column) -> Column:
            scaled = F.zip_with(wrong, F.col("rows"), lambda e, r: e / F.sqrt(F.size(r["at"]).cast("double")))

            def speeds(e: Column) -> Column:
                return F.transform("places", lambda p: F.get(v, p["k"]) * MOMENTUM + F.get(w, p["k"]) * DECAY + F.aggregate(p["of"], F.lit(0.0), lambda s, i: s + F.get(e, i)))

            constant = F.get(v, F.lit(PLACES)) * MOMENTUM + F.aggregate(wrong, F.lit(0.0), lambda s, e: s + e)
            return F.concat(let(scaled, speeds), F.array(constant))

        def next_state(speed: Column) -> Column:
            return F.struct(F.zip_with(w, speed, lambda a, b: a - b * RATE).alias("w"), speed.alias("v"))

        return let(let(F.transform("rows", error), moved), next_state)

    zeros = F.array_repeat(F.lit(0.0), PLACES + 1)
    return both.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(zeros.alias("w"), zeros.alias("v")), lambda s, _: step(s))["w"].alias("w"))


def let(value: Column, body) -> Column:
    """body(value), with the value reckoned once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def labelled_rows() -> list[tuple[str, int]]:
    """(url, 1 for unwanted) of the small labelled table; every choice follows from a hash of its number."""
    out = []

    def url(k: int, unwanted: bool) -> str:
        def one_of(what: str, values):
            return values[xxhash.xxh64_intdigest(f"{what} {k} {unwanted}") % len(values)]

        in_path = unwanted and k % 5 == 0
        words, ends = (UNWANTED if unwanted and not in_path else WANTED), UNWANTED_ENDS if unwanted else WANTED_ENDS
        a = words[k % len(words)]
        if not unwanted and k % 3 == 0:
            a = "".join(one_of(f"letter {j}", ("bdfgklmnprstvz", "aeiou")[j % 2]) for j in range(4 + 2 * (k % 4)))
        b = one_of("beside", (one_of("same", words), one_of("other", BESIDE)))
        name = one_of("shape", (a, f"{a}-{b}", f"{a}{b}", f"{b}{a}", f"{b}-{a}", f"{a}{k % 100}"))
        parts = [one_of(f"part {j}", (one_of(f"word {j}", WANTED), one_of(f"plain {j}", ("en", "de", "fr", "es", "2021", "a", "index.html", "page", "articles", "item", str(k % 1000))))) for j in range(one_of("depth", range(4)))]
        if in_path:
            parts = [*parts[:1], one_of("bad", UNWANTED) + one_of("tail", ("", "-" + one_of("beside", BESIDE)))]
        return f"{one_of('scheme', ('http', 'https'))}://{one_of('front', FRONTS)}{name}.{one_of('end', ends)}/{'/'.join(parts)}"

    for n, unwanted in ((UNWANTED_URLS, True), (WANTED_URLS, False)):
        out += [(url(k, unwanted), int(unwanted)) for k in range(n)]
    return out


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "url string, blocked int")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host and path, and its verdict; null where none fits."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def choose(value) -> Column:
        cases = [(((host == h) | host.endswith("." + h)) & path.startswith(p), value(v, h + p)) for v, h, p in longest]
        return reduce(lambda rest, case: F.when(case[0], F.lit(case[1])).otherwise(rest), reversed(cases), F.lit(None).cast("string"))

    return choose(lambda _, rule: rule), choose(lambda verdict, _: verdict)


def judge(pages: DataFrame, model: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, blocked_score) of each row."""
    host, path = parts(F.col(url))
    cut = pages.select(F.col(key), host.alias("host"), path.alias("path"), model.select("w").scalar().alias("w"))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(F.col("w"), places(F.col("host"), F.col("path")))))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    judged = cut.select(key, "host", "path", rule.alias("rule"), verdict.alias("ruled"), score.alias("blocked_score"))
    return judged.select(key, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked_score") >= THRESHOLD, "block").otherwise("allow")).alias("verdict"), "blocked_score")


def op6_url_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), materialise(fit(labelled_urls(spark))))
