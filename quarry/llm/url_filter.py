"""URL filtering: rules first, then segmented host and path words scored by naive Bayes.

Rules are (host suffix, path prefix) with a verdict.  A rule fits its host and all
subdomains if the path starts with the rule's path; the longest fitting rule decides.
Other urls are judged by the method.

Words.  Hosts (without their last label) and paths are cut into runs of a-z, and each distinct run is split into words by
unigram Viterbi.  Unigrams are the words of all page texts (markup removed), counted over
every row, none left out; example words count as ``EXAMPLE_SHARE`` of all at least.  A run meets the
dictionary by a join on its substrings, so the dictionary is never sent anywhere.

Bayes.  Pages carry no verdicts, so a multinomial model is first fitted on the labelled names in
``BLOCKED`` and ``ALLOWED``; many of their words stand on both sides (free, cheap, win, farm, track), and
it is their company that decides.  That model scores the words of each host in the table; hosts it is sure of become examples,
and the words of all their urls, counted once a host, are learned as well (self-training).  The final word
probabilities are an even mixture of both sources, each smoothed towards the words' overall shares, so what the table adds does
not grow with its size.  Words that neither source knows, and digits, say nothing; the prior is ``PRIOR``.
Rule verdicts are not training data: they judge whole domains, and their languages
and top-level domains would be learned in place of their content.

Scale: texts are only counted.  All else runs over distinct runs, hosts and (host, path shape) pairs, where a
shape has its digits collapsed; joins on words, runs and hosts have an exchange of their own on both
sides, so adaptive execution splits hot ones.  The driver receives one total.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule and
are judged by the prior; the host is taken as written, port and user part included; a run of letters of any length is split;
empty tables give no rows; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import text as tx
from quarry.llm.common import join_grouped, written
from quarry.llm.html_extract import split_url


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Labelled names, as words.
BLOCKED = (
    "casino win", "online casino bonus", "best casino slots", "casino jackpot", "free casino spins", "poker win cash", "online poker", "free bets", "live betting tips", "bets odds bonus",
    "sports betting", "slots win big", "jackpot lottery", "lottery winner", "win free prize", "free cash prize", "gambling bonus", "bingo bonus", "cheap pills", "online pills", "diet pills cheap",
    "buy cheap viagra", "viagra pills", "pharmacy no prescription", "weight loss pills", "cheap loans", "payday loans", "fast cash loans", "bad credit loans", "ads track", "ads server", "ad click",
    "banner ads network", "click track ads", "popup ads", "ads pixel track", "affiliate ads click", "spam farm", "link farm spam", "spam bot", "spam mail list", "click farm", "seo link spam",
    "adult x", "adult video xxx", "adult sex chat", "free porn", "porn video", "sex cams", "live sex", "nude cams", "xxx movies", "hot escort", "escort girls", "adult dating sex", "x rated video", "adult x cams", "xxx adult x", "x videos adult",
    "warez download", "free warez crack", "crack serial keygen", "keygen download", "torrent warez", "malware download", "phishing login", "fake login bank", "replica watches cheap", "cheap replica bags",
    "get rich fast", "make money fast", "free bitcoin win", "crypto bonus free", "hack account free", "free followers bot", "miracle cure", "work home cash", "win big fast",
)
ALLOWED = (
    "daily news", "city news online", "world news live", "weather report", "free library", "public library", "free software", "open source software", "cheap flights", "cheap travel tips", "online courses",
    "online store", "book store", "adult education", "dairy farm", "family farm", "farm animals", "wind farm energy", "track field", "race track", "track repair", "train track",
    "fast food", "fast train", "hot springs hotel", "live music", "live concert", "music video", "video games", "movies review", "game review", "win the match", "football league", "sports club", "team sports news",
    "credit union", "home loans bank", "student loans help", "bank account", "login help", "mail server", "web server", "social network", "network school", "link library", "download manual", "software download",
    "health clinic", "city hospital", "pharmacy school", "diet recipes", "weight training", "cooking recipes", "garden plants", "travel stories", "photo gallery", "art museum", "history museum", "science journal", "research lab", "university press",
    "primary school", "math lessons", "language school", "dating fossils", "girls school", "watch repair", "bags and shoes", "prize for science", "nobel prize", "money museum", "work safety", "home garden",
    "big river park", "national park", "water works", "real estate agency", "law office",
)
#: Words of urls that say nothing by themselves; the dictionary has them besides the counted ones.
COMMON = frozenset("blog com example html http index page shop site web www".split())
#: Share of all words that an example word has at least, and longest word of the dictionary in letters.
EXAMPLE_SHARE, LONGEST = 1e-4, 24
#: Log odds of a blocked url before its words are read; log odds beyond which a host becomes an example; weight of the smoothing and of the table's own words.
PRIOR, MARGIN, SMOOTHING, OWN = math.log(0.1 / 0.9), 1.0, 5.0, 0.5

#: Example words by class: (blocked, allowed) occurrences.
LABELLED = {w: (b, a) for b_words, a_words in [(Counter(w for n in BLOCKED for w in n.split()), Counter(w for n in ALLOWED for w in n.split()))] for w in b_words | a_words for b, a in [(b_words[w], a_words[w])]}
ADDED = sorted(LABELLED.keys() | COMMON)
LABELLED_TOTALS = sum(b for b, _ in LABELLED.values()), sum(a for _, a in LABELLED.values())


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name and verdict of the longest fitting rule, as a struct; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.name)):  # later ones win
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def split_run(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The cheapest split of a run into words of the counts; ties go to longer last words.  One-letter words stand alone only.

    A word costs the log of its rarity; letters outside all words cost more than the rarest word each, and a stretch of them is ``?``.
    """
    n = len(run)
    unknown = math.log(total + 1) + 2.0
    longest = max(map(len, counts), default=0)
    cost = {w: math.log((total + 1) / c) for w, c in counts.items()}
    best = [0.0] + [math.inf] * n
    back = [(0, False)] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            c = cost.get(run[start:end])
            if c is not None and best[start] + c < best[end] and (end - start > 1 or n == 1):
                best[end], back[end] = best[start] + c, (start, True)
        if best[end - 1] + unknown < best[end]:
            best[end], back[end] = best[end - 1] + unknown, (end - 1, False)
    out: list[str] = []
    end = n
    while end:
        start, known = back[end]
        if known:
            out.append(run[start:end])
        elif not out or out[-1] != "?":
            out.append("?")
        end = start
    return out[::-1]


def labelled_odds(word: str) -> float:
    """Log odds of a word for blocking by the labelled names alone; 0 for words they do not have."""
    if word not in LABELLED:
        return 0.0
    (b, a), (b_all, a_all) = LABELLED[word], LABELLED_TOTALS
    share = SMOOTHING * (b + a) / (b_all + a_all)
    return math.log((b + share) / (b_all + SMOOTHING)) - math.log((a + share) / (a_all + SMOOTHING))


def unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): the words of the pages' texts, counted over all rows."""
    text = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " "))
    words = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}])([a-z]{{2,{LONGEST}}})(?![\p{{L}}])"), F.lit(1))
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def dictionary(pages: DataFrame, html_col: str = "html") -> tuple[DataFrame, int]:
    """(word, n) with the example words, and the total of the counts."""
    counted = written(unigrams(pages, html_col), "words")
    total = counted.agg(F.sum("n")).collect()[0][0] or 0
    least = max(1, round(EXAMPLE_SHARE * total))
    examples = pages.sparkSession.createDataFrame([(w, least) for w in ADDED], "word string, n bigint")
    return counted.union(examples).groupBy("word").agg(F.max("n").alias("n")), total + least * len(ADDED)


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("([a-z]+)"), F.lit(1))


def _host_part(host: Column) -> Column:
    """The host without its last label, if it has several."""
    return F.regexp_replace(host, r"\.[^.]*$", "")


def _split_all(total: int):
    def run(batches):
        for batch in tx.chunks(batches, "run"):
            words = [split_run(r, {c["word"]: c["n"] for c in found or []}, total) for r, found in zip(batch.column("run").to_pylist(), batch.column("found").to_pylist(), strict=True)]
            odds = [sum(map(labelled_odds, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(words, pa.list_(pa.string())), pa.array(odds, pa.float64())], ["run", "words", "first_odds"])

    return run


def segmented(runs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(run, words, first_odds) of distinct runs: their split, and its log odds by the labelled names."""
    # substrings travel with a digest of their run, which may be long
    keyed = runs.select("run", F.md5("run").alias("run_key"))
    at = keyed.select("run", "run_key", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    longest = at.select("run_key", F.expr(f"substring(run, at, {LONGEST})").alias("rest"))
    subs = longest.select("run_key", F.explode(F.transform(F.sequence(F.lit(1), F.length("rest")), lambda n: F.substring("rest", F.lit(1), n))).alias("word")).distinct()
    found = join_grouped(subs, words, ["word"]).groupBy("run_key").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    return keyed.join(found, "run_key", "left").select("run", "found").mapInArrow(_split_all(total), "run string, words array<string>, first_odds double")


def model(hosts: DataFrame, splits: DataFrame) -> DataFrame:
    """(word, odds): log odds of each word of the table's runs; hosts: distinct (host, run, in_host)."""
    held = join_grouped(hosts, splits, ["run"])
    score = F.round(F.sum("first_odds") + F.lit(PRIOR), 9)
    classes = held.where("in_host").groupBy("host").agg(score.alias("s")).where(F.abs("s") > MARGIN).select("host", (F.col("s") > 0).cast("long").alias("blocked"))
    seen = held.select("host", F.explode("words").alias("word")).where("word <> '?'").distinct()
    own = join_grouped(seen, classes, ["host"]).groupBy("word").agg(F.sum("blocked").alias("b"), F.sum(1 - F.col("blocked")).alias("a"))
    known = hosts.sparkSession.createDataFrame([(w, b, a) for w, (b, a) in LABELLED.items()], "word string, lb bigint, la bigint")
    both = written(own.join(known, "word", "full").na.fill(0, ["b", "a", "lb", "la"]), "odds")
    sums = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("b", "a")]).collect()[0]
    b_all, a_all = LABELLED_TOTALS
    share = (F.col("b") + F.col("a") + F.col("lb") + F.col("la")) / F.lit(float(sums["b"] + sums["a"] + b_all + a_all)) * SMOOTHING

    def p(own_n: str, own_all: int, n: str, n_all: int) -> Column:
        return (1 - OWN) * (F.col(n) + share) / F.lit(n_all + SMOOTHING) + OWN * (F.col(own_n) + share) / F.lit(own_all + SMOOTHING)

    return both.select("word", (F.log(p("b", sums["b"], "lb", b_all)) - F.log(p("a", sums["a"], "la", a_all))).alias("odds"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of the method for blocking), words."""
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("shape", F.regexp_replace("path", "[0-9]+", "0"))
    sites = written(urls.select("host", "shape").distinct(), "sites")
    in_host, in_path = _letters(_host_part(F.col("host"))), _letters(F.col("shape"))
    hosts = written(
        sites.select("host", F.explode(in_host).alias("run"), F.lit(True).alias("in_host")).union(sites.select("host", F.explode(in_path).alias("run"), F.lit(False).alias("in_host"))).distinct(), "runs"
    )
    words, total = dictionary(pages, html_col)
    splits = written(segmented(hosts.select("run").distinct(), words, total), "splits")
    odds = model(hosts, splits)
    of_run = join_grouped(splits.select("run", F.explode("words").alias("word")), odds, ["word"]).groupBy("run").agg(F.sum("odds").alias("odds"))
    runs = splits.join(of_run, "run", "left").select("run", F.array_join("words", " ").alias("words"), F.coalesce("odds", F.lit(0.0)).alias("odds"))
    parts = sites.select("host", "shape", F.posexplode(F.concat(in_host, in_path)).alias("pos", "run"))
    scored = join_grouped(parts, runs, ["run"]).groupBy("host", "shape").agg(F.sum("odds").alias("odds"), F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("w"))
    scored = sites.join(scored, ["host", "shape"], "left").select(
        "host", "shape", (F.coalesce("odds", F.lit(0.0)) + F.lit(PRIOR)).alias("score"), F.coalesce(F.array_join(F.col("w.words"), " "), F.lit("")).alias("words")
    )
    return join_grouped(urls, scored, ["host", "shape"]).withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score", "words"
    )


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"), "words")
