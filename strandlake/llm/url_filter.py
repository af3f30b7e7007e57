"""URL filters: rules by host and path, and for all other URLs a naive Bayes model over segmented host and path words.

Hosts and paths are cut with column expressions. Names that run together ("casinowin") are split by Viterbi over a
unigram model of words that hosts and paths of the corpus show between marks. Multinomial naive Bayes is trained on the
words that these splits give, all URLs counted: a URL is an example of "block" where a seed word is among the words of
its host, else of "allow". Seed words are examples, not rules: what else such hosts and their paths are made of scores as
well.

The counts of all words stay a Spark table. Stretches of the distinct names join it, so that each name is split with
the words it holds, however long these are; a name of any length is split as a whole.
"""

from __future__ import annotations

import math
import zlib
from collections import ChainMap

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import ascii_lower, id_filter, in_filter, read, stored

#: (verdict, host, path): fixed values of the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Words that mark a host as an example of "block".
SEED_WORDS = ["ads", "adult", "bet", "bets", "casino", "cheap", "crack", "escort", "loan", "loans", "pills", "poker", "porn", "replica", "sex", "spam", "track", "viagra", "warez", "xxx"]
#: Words meet names by their first letters, so many of them at most; longer words are compared with what follows there.
KEY_LETTERS = 24
#: Words of up to so many letters are held by every task; the alphabet has 47,988 of them.
SHORT_WORD = 3
MARKS = "[^a-z0-9]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for URLs without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, null without one; equal lengths: first in order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def split(name: str, cost: dict[str, float], unknown: float, sizes: tuple[int, ...] = ()) -> tuple[str, ...]:
    """From a name to its most likely words: stretches of up to KEY_LETTERS letters, and of the sizes of longer words.
    Unknown stretches cost more with each letter."""
    best = [(0.0, 0)]
    for j in range(1, len(name) + 1):
        near = [(best[i][0] + cost.get(name[i:j], unknown + 2.5 * (j - i)), i) for i in range(max(0, j - KEY_LETTERS), j)]
        far = [(best[j - n][0] + cost[name[j - n : j]], j - n) for n in sizes if n <= j and name[j - n : j] in cost]
        best.append(min(near + far))
    out, j = [], len(name)
    while j:
        i = best[j][1]
        out.append(name[i:j])
        j = i
    return tuple(out[::-1])


def names(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), MARKS), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))


def bare_host(host: Column) -> Column:
    """A host without its last label."""
    return F.when(F.contains(host, F.lit(".")), F.regexp_replace(host, "\\.[^.]*$", "")).otherwise("")


def unigrams(urls: DataFrame, seeds: list[str] = SEED_WORDS) -> tuple[DataFrame, float]:
    """(w, n) of words that stand between marks, in paths and in host labels with marks, and the sum of n. Labels without
    marks may be words run together, so the splitter does not learn from them. Seed words count as seen once."""
    marked = F.array_join(F.filter(F.split(bare_host(F.col("host")), "\\."), lambda x: x.rlike("[^a-z0-9]")), ".")
    words = urls.select(F.explode(F.concat(names(marked), names(F.col("path")))).alias("w"))
    known = urls.sparkSession.createDataFrame([(s,) for s in sorted(set(seeds))], "w string")
    words = stored(words.withColumn("n", F.lit(1)).union(known.withColumn("n", F.lit(0))).groupBy("w").agg(F.greatest(F.sum("n"), F.lit(1)).alias("n")))
    return words, words.agg(F.sum("n")).first()[0] + 1.0


def split_names(distinct: DataFrame, words: DataFrame, total: float) -> DataFrame:
    """(name, words) of distinct names. Of a name's stretches only those leave the scan that a fixed-size filter over the
    words' first letters passes; they join the words, and longer words have to go on as the name does."""
    keyed = distinct.select(F.md5("name").alias("k"), "name")
    long = words.where(F.length("w") > SHORT_WORD).withColumn("key", F.left("w", F.lit(KEY_LETTERS)))
    known = id_filter(long.select(F.crc32(F.col("key").cast("binary")).alias("c")), "c")

    def stretches(frames):
        for f in frames:
            out: set[tuple[str, str]] = set()
            for k, name in zip(f["k"], f["name"], strict=True):
                for i in range(len(name) - SHORT_WORD):
                    some = [name[i:j] for j in range(i + SHORT_WORD + 1, min(len(name), i + KEY_LETTERS) + 1)]
                    passed = in_filter(known, np.fromiter((zlib.crc32(x.encode()) for x in some), np.int64, len(some)))
                    out.update((k, some[j]) for j in np.flatnonzero(passed).tolist())
                    if len(out) > 100_000:
                        yield pd.DataFrame(list(out), columns=["k", "key"])
                        out = set()
            yield pd.DataFrame(list(out), columns=["k", "key"])

    met = stored(keyed.mapInPandas(stretches, "k string, key string").join(long, "key").select("k", "w", "n"))
    beyond = F.length("w") > KEY_LETTERS
    held = met.where(beyond).distinct().join(keyed, "k").where(F.contains("name", F.col("w"))).select("k", "w", "n")
    met = met.where(~beyond).union(held)
    hits = met.groupBy("k").agg(F.collect_set(F.struct("w", "n")).alias("hits"))
    short = {r["w"]: -math.log(r["n"] / total) for r in words.where(F.length("w") <= SHORT_WORD).collect()}
    unknown = math.log(total) + 2.0

    def run(frames):
        for f in frames:
            out = []
            for name, found in zip(f["name"], f["hits"], strict=True):
                own = {x["w"]: -math.log(x["n"] / total) for x in found} if found is not None else {}
                sizes = tuple(sorted({len(w) for w in own if len(w) > KEY_LETTERS}))
                out.append((name, list(split(name, ChainMap(own, short), unknown, sizes))))
            yield pd.DataFrame(out, columns=["name", "words"])

    return stored(keyed.join(hits, "k", "left").select("name", "hits").mapInPandas(run, "name string, words array<string>"))


def segmented(urls: DataFrame, seeds: list[str] = SEED_WORDS) -> DataFrame:
    """(row, at, bad, words): the words of each name of each URL (row, host, path), and whether a seed word is among those
    of its host."""
    host = names(bare_host(F.col("host")))
    parts = urls.select("row", F.size(host).alias("n"), F.posexplode(F.concat(host, names(F.col("path")))).alias("at", "name"))
    cut = parts.join(split_names(parts.select("name").distinct(), *unigrams(urls, seeds)), "name")
    seeded = (F.col("at") < F.col("n")) & F.arrays_overlap("words", F.array(*map(F.lit, seeds)))
    return stored(cut.withColumn("bad", F.max(seeded).over(Window.partitionBy("row"))).select("row", "at", "bad", "words"))


def fit(parts: DataFrame) -> tuple[DataFrame, float]:
    """(w, odds): log odds of each word for "block", and those of a URL without words, by counts of all URLs with names
    in parts (rows of segmented())."""
    words = stored(parts.select("bad", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.count_if("bad").alias("b")))
    n, nb, ng = words.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum(F.col("n") - F.col("b")), F.lit(0))).first()
    total, bad = parts.where("at = 0").agg(F.count("*"), F.count_if("bad")).first()
    odds = F.log((F.col("b") + 1) / float(nb + n + 1)) - F.log((F.col("n") - F.col("b") + 1) / float(ng + n + 1))
    return words.select("w", odds.alias("odds")), math.log((bad + 1) / (total - bad + 1))


def scored(parts: DataFrame, model: tuple[DataFrame, float]) -> DataFrame:
    """(row, score, words) of URLs with names: log odds for "block". Words that the model has not seen have none."""
    odds, prior = model
    words = parts.select("row", "at", F.posexplode("words").alias("nth", "w")).join(odds, "w", "left")
    per_row = words.groupBy("row").agg(F.sum(F.coalesce("odds", F.lit(0.0))).alias("s"), F.array_sort(F.collect_list(F.struct("at", "nth", "w"))).alias("p"))
    return per_row.select("row", (F.lit(prior) + F.round("s", 9)).alias("score"), F.array_join("p.w", " ").alias("words"))


def cut_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    return stored(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score, words. score is the model's log odds for "block"; without
    a rule a score over 0 blocks. URLs without a host are allowed, score null."""
    urls = cut_urls(pages, id_col, url_col)
    parts = segmented(urls.where("host <> ''"))
    model = fit(parts)
    judged = urls.join(scored(parts, model), "row", "left").withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    score = F.when(F.col("host") != "", F.coalesce("score", F.lit(model[1])))
    learned = F.when(score > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), learned).alias("verdict"), score.alias("score"), F.coalesce("words", F.lit("")).alias("words"))


def op5(spark, sf_dir):
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"))
