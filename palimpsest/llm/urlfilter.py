"""URL rules, and for URLs without one a naive Bayes verdict over segmented host and path words."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, cut_lineage, row_slices, small, with_row_ids

#: What may be a word: runs of 2 to so many letters. A longer name is a sequence of words.
LONGEST_WORD = 40


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: The production rules.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (verdict, name) of the longest rule that fits; equally long ones in the order given; else null."""
    longest = sorted(rules, key=lambda r: -len(r.name))
    fits = [
        F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name")))
        for r in longest
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,name:string>")


def best_split(name: str, cost: Callable[[int, int], float | None], total: int) -> list[str]:
    """Unigram Viterbi: the most probable split of a name. ``cost(start, size)`` is that of a known word, None of any
    other run, which costs by its length; of equal splits the one with the longer last word."""
    unknown, letter = math.log(total) + math.log(10), math.log(10)
    best = [0.0] + [math.inf] * len(name)
    back = [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            known = cost(start, end - start)
            total_cost = best[start] + (known if known is not None else unknown + letter * (end - start))
            if total_cost < best[end]:
                best[end], back[end] = total_cost, start
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


class Segmenter:
    """best_split() with all word counts at hand."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values()) or 1
        self.cost = {w: math.log(self.total) - math.log(n) for w, n in counts.items()}

    def split(self, name: str) -> list[str]:
        return best_split(name, lambda start, size: self.cost.get(name[start : start + size]), self.total)


def _runs(text: Column) -> Column:
    """Runs of letters and runs of digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\p{Nd}+)"), 1)


def piece_counts(names: DataFrame) -> DataFrame:
    """``word, n``: each beginning and end, of two letters or more, of the distinct ``run`` of ``names``, and the run
    itself. A piece counts once for each run that it begins or ends, so a piece that many names share outweighs them."""
    sizes = F.sequence(F.lit(2), F.least(F.length("run"), F.lit(LONGEST_WORD)))
    ends = F.concat(F.transform(sizes, lambda n: F.substr(F.col("run"), F.lit(1), n)), F.transform(sizes, lambda n: F.right(F.col("run"), n)))
    return names.filter(F.length("run") >= 2).select(F.explode(ends).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def splits(names: DataFrame) -> DataFrame:
    """``run, words`` of every distinct run of letters: what the pieces within it cost is looked up by a join."""
    counts = cut_lineage(piece_counts(names))
    total = counts.agg(F.sum("n")).first()[0] or 1
    starts = names.filter(F.length("run") >= 2).select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 2)).alias("start"))
    longest = F.least(F.length("run") - F.col("start"), F.lit(LONGEST_WORD))
    within = starts.select("run", "start", F.explode(F.sequence(F.lit(2), longest)).alias("size"))
    known = within.withColumn("word", F.substr(F.col("run"), F.col("start") + 1, F.col("size"))).join(counts, "word")
    found = known.groupBy("run").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))

    def run(batches):
        for batch in row_slices(batches, 256):
            words = []
            for name, known in zip(batch.column("run").to_pylist(), batch.column("known").to_pylist(), strict=True):
                cost = {(k["start"], k["size"]): math.log(total) - math.log(k["n"]) for k in known or ()}
                words.append(best_split(name, lambda start, size, cost=cost: cost.get((start, size)), total))
            yield pa.record_batch([batch.column("run"), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return names.join(found, "run", "left").select("run", "known").mapInArrow(run, "run string, words array<string>")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score, words`` for every row of ``pages``.

    The longest fitting rule decides. The other URLs get the verdict of a multinomial naive Bayes that the
    URLs with a rule train: their hosts and paths are cut into words by a unigram Viterbi, whose word counts
    are those of all hosts and paths (a name not cut by punctuation is a candidate word, and so are the parts
    that other names share with it); a run of digits counts by how many it has. Host words and path words are
    features of their own. ``score`` is the log odds of block; ties are allow. All counts cover all rows and are
    kept whole: they are summed before anything moves, and names, pieces and words meet them by joins, broadcast
    only where a count shows that they are few. Null URLs and those without :// have empty host and path, no words,
    and the verdict of the class priors, as all URLs have if no rule ever fits. URLs of any length are read whole.
    Repeated rows, also under one page_id, get equal answers; an empty table gives an empty result; other columns
    are ignored.
    """
    rows, row = with_row_ids(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")), "page_id", "url")
    base = rows.select(row, "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    tagged = lambda side, text: F.transform(_runs(F.col(text)), lambda r: F.struct(F.lit(side).alias("side"), r.alias("run")))
    runs = base.select(row, F.col("fit.verdict").alias("ruled"), F.posexplode(F.concat(tagged("h", "host"), tagged("p", "path"))).alias("pos", "at")).select(row, "ruled", "pos", "at.side", "at.run")
    names = cut_lineage(runs.groupBy("side", "run").agg(F.count_if(F.col("ruled") == "block").alias("b"), F.count_if(F.col("ruled") == "allow").alias("a")))
    letters = names.filter(F.col("run").rlike(r"^\p{L}")).select("run").distinct()
    cut = splits(letters).unionByName(names.filter(F.col("run").rlike(r"^\p{Nd}")).select("run").distinct().select("run", F.array(F.concat(F.lit("#"), F.length("run"))).alias("words")))
    worded = cut_lineage(names.join(cut, "run"))
    priors = base.agg(F.count_if(F.col("fit.verdict") == "block").alias("b"), F.count_if(F.col("fit.verdict") == "allow").alias("a")).first()
    features = cut_lineage(worded.select("side", "a", "b", F.explode("words").alias("word")).groupBy("side", "word").agg(F.sum("b").alias("b"), F.sum("a").alias("a")).filter("a + b > 0"))
    size, n_b, n_a = features.agg(F.count(F.lit(1)) + 1, F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    weight = F.log((F.col("b") + 1) / F.lit(n_b + size)) - F.log((F.col("a") + 1) / F.lit(n_a + size))
    weights = features.select("side", "word", weight.alias("weight"))
    scores = worded.select("side", "run", F.explode("words").alias("word")).join(weights, ["side", "word"], "left").groupBy("side", "run").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    judged = small(worded.select("side", "run", "words").join(scores, ["side", "run"]))
    per_url = runs.join(judged, ["side", "run"]).groupBy(row).agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("pos", "side", "words"))).alias("parts"))
    prior = math.log(priors["b"] + 1) - math.log(priors["a"] + 1)
    score = F.round(F.lit(prior) + F.coalesce("weight", F.lit(0.0)), 9)
    words = F.flatten(F.transform("parts", lambda p: F.transform(p["words"], lambda w: F.concat(p["side"], F.lit(":"), w))))
    judged_urls = base.join(per_url, row, "left").withColumn("score", score)
    method = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged_urls.select("page_id", "host", "path", F.col("fit.name").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "score", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
