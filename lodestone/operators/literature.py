"""Operators on titles, quotes, sections, names and rounds of a literature search."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import collapse, name_key


def title_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Similarity of two titles by longest matching blocks (Ratcliff and Obershelp), which no built-in function gives.

    Below ``least`` it is 0; pairs whose lengths or letters rule it out are not aligned.
    """

    def one(p: str | None, q: str | None) -> float:
        m = SequenceMatcher(None, p or "", q or "", autojunk=False)
        if m.real_quick_ratio() < least or m.quick_ratio() < least:
            return 0.0
        r = m.ratio()
        return r if r >= least else 0.0

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def answer_titles(asked: DataFrame, answers: DataFrame, keys: list[str], title: str, answer: str, found: str, least: float = 0.82) -> DataFrame:
    """(keys, match, ratio): of the answers to each asked title, found under the same keys, the best at ``least`` or more.

    Equal normalised titles are 1, blank ones never match, ties go to the smaller answer. Pairs that are equal or too
    different in length do not reach Python.
    """
    l = asked.select(*keys, name_key(F.col(title), True).alias("_t")).where("_t <> ''")  # noqa: E741
    r = answers.select(*keys, F.col(answer).alias("_o"), name_key(F.col(found), True).alias("_u")).where("_u <> ''")
    pairs = l.join(r, keys)
    size = lambda c: F.length(c).cast("double")
    could = 2 * F.least(size("_t"), size("_u")) >= least * (size("_t") + size("_u"))  # no ratio is above this
    unlike = pairs.where((F.col("_t") != F.col("_u")) & could).withColumn("ratio", title_ratio(F.col("_t"), F.col("_u"), least))
    both = pairs.where(F.col("_t") == F.col("_u")).withColumn("ratio", F.lit(1.0)).unionByName(unlike)
    best = F.min(F.struct((-F.col("ratio")).alias("r"), F.col("_o")))
    return both.where(F.col("ratio") >= least).groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b._o").alias("match"), (-F.col("_b.r")).alias("ratio"))


def overlap_score(name: Column, target: Column) -> Column:
    """4 if the target stands in the name, 3 if the name stands in the target, and 1 for each shared word."""
    a, b = F.split(F.lower(name), " "), F.split(F.lower(target), " ")
    return F.when(F.lower(name).contains(F.lower(target)), 4).otherwise(0) + F.when(F.lower(target).contains(F.lower(name)), 3).otherwise(0) + F.size(F.array_intersect(a, b))


def title_like(quote: Column, title: Column, least_words: int = 6) -> Column:
    """A quote of enough words that equals the title, begins it or begins with it, or holds at least half of it."""
    q, t = name_key(quote, True), name_key(title, True)
    same = (q == t) | t.startswith(q) | q.startswith(t) | (t.contains(q) & (F.length(q) * 2 >= F.length(t)))
    return F.coalesce((F.size(F.split(q, " ")) >= least_words) & (t != "") & same, F.lit(False))


def result_quotes(quotes: Column, pattern: str, roles: tuple[str, ...] = ("direct_result", "review_synthesis")) -> Column:
    """The number of quotes (structs of role and text) that report a result."""
    return F.size(F.filter(quotes, lambda q: q["role"].isin(*roles) & F.lower(q["text"]).rlike(pattern)))


def section_budget(sections: Column, most: int) -> Column:
    """Sections (structs of name and text, in order of priority) as long as room is left; the last is cut to what remains less 2."""
    start = F.struct(F.array().cast("array<struct<name:string,text:string>>").alias("out"), F.lit(most).alias("left"))

    def step(state, s):
        cut = F.substring(s["text"], F.lit(1), F.greatest(state["left"] - 2, F.lit(0)))
        return F.when((state["left"] > 2) & (F.length(s["text"]) > 0), F.struct(F.concat(state["out"], F.array(F.struct(s["name"].alias("name"), cut.alias("text")))).alias("out"), (state["left"] - F.length(cut) - 2).alias("left"))).otherwise(state)

    return F.aggregate(sections, start, step)["out"]


def search_name(name: Column, forms: list[str], leading: list[str]) -> Column:
    """The name without form words and without descriptors in front; the name itself if nothing is left."""
    words = F.filter(F.split(F.lower(collapse(name)), " "), lambda w: ~w.isin(*forms))
    kept = F.filter(words, lambda w, i: (i > 0) | ~w.isin(*leading))
    out = F.array_join(kept, " ")
    return F.when(out != "", out).otherwise(F.lower(collapse(name)))


def public_url(doi: Column, pmid: Column, landing: Column) -> Column:
    nonblank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(F.concat(F.lit("https://doi.org/"), nonblank(doi)), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), nonblank(pmid), F.lit("/")), nonblank(landing))


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, and those of both; one shuffle of the keys."""
    both = left.select(key, F.lit(1).alias("s")).unionByName(right.select(key, F.lit(2).alias("s"))).where(F.col(key).isNotNull())
    side = F.bit_or("s")
    return both.groupBy(key).agg(F.when(side == 1, "left").when(side == 2, "right").otherwise("both").alias("side"))


def expand_rounds(page: Callable[[int], DataFrame], key: str, target: int, most_rounds: int, idle: int = 2) -> tuple[DataFrame | None, str, list[int]]:
    """Rounds of new rows until the target, the round limit, or ``idle`` rounds without a new key: rows, reason, new rows by round.

    Each round's rows are checkpointed; only their number comes to the driver.
    """
    from ..streaming.events import work_folder

    found, news = None, []
    for k in range(most_rounds):
        rows = page(k).dropDuplicates([key])
        context = rows.sparkSession.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(work_folder(rows.sparkSession))
        fresh = rows if found is None else rows.join(found.select(key), key, "left_anti")
        fresh = fresh.checkpoint()
        news.append(fresh.count())
        found = fresh if found is None else found.unionByName(fresh)
        if sum(news) >= target:
            return found, "target_met", news
        if len(news) >= idle and not any(news[-idle:]):
            return found, "no_new_rows", news
    return found, "max_rounds", news


def first_page(df: DataFrame, order: list[str], target: int) -> DataFrame:
    return df.orderBy(*order).limit(target)


def evidence_order(level: Column, score: Column) -> list[Column]:
    """Strong, medium, low, then others; the higher score first, null last."""
    rank = F.when(level == "strong", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0)
    return [rank.desc(), F.coalesce(score, F.lit(-1.0)).desc()]


def per_group_top(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= most).drop("_k")
