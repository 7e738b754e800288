"""Operators on document texts: tests, cuts, visible text, ranking and term search."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let, truncate_words


def article_test(text: Column, markers: list[str], denials: list[str], least: int = 1500, needed: int = 2) -> dict[str, Column]:
    """long_enough, denied, n_markers and is_article of a text."""
    low = F.lower(text)
    n = F.aggregate(F.array(*(F.lit(m) for m in markers)), F.lit(0), lambda a, m: a + F.contains(low, m).cast("int"))
    denied = F.exists(F.array(*(F.lit(m) for m in denials)), lambda m: F.contains(low, m))
    long = F.length(text) >= least
    return {"long_enough": long, "denied": denied, "n_markers": n, "is_article": long & ~denied & (n >= needed)}


def cut_at_heading(text: Column, heading: str, least: int) -> Column:
    """The text before the earliest line that starts with ``heading`` after at least ``least`` characters; else all of it."""
    before = F.regexp_extract(text, f"(?s)^(.{{{least},}}?)\\n{heading}", 1)
    return F.when(before != "", before).otherwise(text)


def cut_last_heading(text: Column, heading: str, share: float = 0.45) -> Column:
    """The text before the last line that starts with ``heading``, if that lies beyond ``share`` of the text."""
    before = F.regexp_extract(text, f"(?s)^(.*)\\n{heading}", 1)
    return F.when((before != "") & (F.length(before) >= F.length(text) * share), before).otherwise(text)


#: Elements whose text is not shown, and kinds of descriptions (fixed values).
HIDDEN = ["script", "style", "noscript", "svg", "nav", "footer", "header", "form"]
DESCRIPTIONS = ["description", "og:description", "twitter:description"]

_PARTS = re.compile(
    r"""<!--.*?(?:-->|\Z) | <![^>]*> | <\?[^>]*>
    | <(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
    | <(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>
    | (?P<text>[^<]+|<)""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([a-z:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def shown(page: str, descriptions: bool):
    """The collapsed texts between tags outside hidden elements, in page order, with meta descriptions where they stand."""
    inside: list[str] = []  # open hidden elements
    for part in _PARTS.finditer(page):
        name = (part["name"] or "").lower()
        if part["text"]:
            if not inside:
                yield False, " ".join(entities.unescape(part["text"]).split())
        elif name in HIDDEN and not part["end"]:
            inside.append(name)
        elif name in HIDDEN and name in inside:
            while inside.pop() != name:
                pass
        elif name == "meta" and descriptions:
            a = {k.lower(): entities.unescape(x or y or z) for k, x, y, z in _ATTRIBUTE.findall(part["attrs"])}
            if (a.get("name") or a.get("property") or "").lower() in DESCRIPTIONS:
                yield True, " ".join(a.get("content", "").split())


def visible(page: str | None, least: int = 20, most: int | None = 1200) -> str | None:
    """Meta descriptions and visible chunks of at least ``least`` characters, in page order, without repeats."""
    if not page:
        return None
    out = " ".join(dict.fromkeys(t for meta, t in shown(page, True) if t and (meta or len(t) >= least)))
    return (out if most is None else out[:most].strip()) or None


def body_text(page: Column, least: int = 2, most: int = 250_000) -> Column:
    """The visible text of a page, repeats kept, cut at a word; an article if ``article_test`` says so."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: " ".join(t for _, t in shown(x, False) if len(t) >= least) if x else None)

    return truncate_words(run(page), most)


def article_body(page: Column, markers: list[str], denials: list[str]) -> Column:
    """The body text of a page that passes the article test; null otherwise."""
    return let(body_text(page), lambda text: F.when(article_test(text, markers, denials)["is_article"], text))


def backfilled(rows: DataFrame, page: str, abstract: str = "abstract", summary: str = "page_summary") -> DataFrame:
    """Rows with neither abstract nor summary get the summary of their landing page."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    wanted = F.when(blank(abstract) & blank(summary), F.col(page))
    return rows.withColumn(summary, F.coalesce(F.when(~blank(summary), F.col(summary)), visible_text(wanted)))


def visible_text(page: Column, least: int = 20, most: int | None = 1200) -> Column:
    """Nested skipping needs a parser: an Arrow-batched pandas UDF."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: visible(x, least, most))

    return run(page)


def ranked(df: DataFrame, text: Column, weights: list[tuple[str, int]], group: list[str], tie: str, most: int) -> DataFrame:
    """The rows with the highest sum of weights of matching patterns, by group; ties by ``tie``."""
    score = sum((F.when(text.rlike(p), w).otherwise(0) for p, w in weights), F.lit(0))
    w = Window.partitionBy(*group).orderBy(F.desc("score"), tie)
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def term_search(df: DataFrame, text: Column, terms: list[str], tie: str, most: int) -> DataFrame:
    """(id, score): one point for each term contained; scores above 0, best first."""
    score = sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return df.select(tie, score.alias("score")).where("score > 0").orderBy(F.desc("score"), tie).limit(most)


def token_aliases(df: DataFrame, column: str, aliases: list[str]) -> DataFrame:
    """A row for each alias (a short configured list) that the text holds as whole tokens."""
    padded = F.concat(F.lit(" "), F.lower(column), F.lit(" "))
    return df.withColumn("alias", F.explode(F.filter(F.array(*(F.lit(a) for a in aliases)), lambda a: F.contains(padded, F.concat(F.lit(" "), a, F.lit(" "))))))


def from_inverted_index(index: Column) -> Column:
    """The text of a map word -> positions: words by (position, word), joined with spaces."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")
