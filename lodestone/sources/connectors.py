"""Search connectors as a replayable source: answers of web services are an input table.

A connector is a payload schema and a projection to citations. Whatever fetches the pages (a service client, a crawl) writes
rows (source, query, page, status, payload); the engine reads them, so that every result can be made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalize_doi, year_of

#: Payload schemas (fixed formats of the public services, the fields that are used).
SCHEMAS = {
    "openalex": "results array<struct<id:string,doi:string,display_name:string,publication_year:int,abstract_inverted_index:map<string,array<int>>>>",
    "europe_pmc": "resultList struct<result:array<struct<id:string,doi:string,pmid:string,title:string,pubYear:string,abstractText:string>>>",
    "crossref": "message struct<items:array<struct<DOI:string,title:array<string>,abstract:string,issued:struct<`date-parts`:array<array<int>>>>>>",
    "semantic_scholar": "data array<struct<paperId:string,title:string,year:int,abstract:string,externalIds:map<string,string>>>",
}


def _fields(source: str, r: Column) -> dict[str, Column]:
    from ..operators.documents import from_inverted_index

    none = F.lit(None).cast("string")
    if source == "openalex":
        return {"doi": r["doi"], "pmid": none, "title": r["display_name"], "year": r["publication_year"], "abstract": F.when(r["abstract_inverted_index"].isNotNull(), from_inverted_index(r["abstract_inverted_index"]))}
    if source == "europe_pmc":
        return {"doi": r["doi"], "pmid": r["pmid"], "title": r["title"], "year": year_of(r["pubYear"]), "abstract": r["abstractText"]}
    if source == "crossref":
        return {"doi": r["DOI"], "pmid": none, "title": F.get(r["title"], F.lit(0)), "year": F.get(F.get(r["issued"]["date-parts"], F.lit(0)), F.lit(0)), "abstract": F.regexp_replace(r["abstract"], "<[^>]+>", " ")}
    return {"doi": F.try_element_at(r["externalIds"], F.lit("DOI")), "pmid": F.try_element_at(r["externalIds"], F.lit("PubMed")), "title": r["title"], "year": r["year"], "abstract": r["abstract"]}


_LISTS = {"openalex": "results", "europe_pmc": "resultList.result", "crossref": "message.items", "semantic_scholar": "data"}


def citations(answers: DataFrame, source: str) -> DataFrame:
    """(source, query, page, pos, doi, pmid, title, year, abstract) of a service's stored answers; failed pages give none."""
    rows = answers.where((F.col("source") == source) & (F.col("status") == 200)).select("source", "query", "page", F.from_json("payload", SCHEMAS[source]).alias("p"))
    flat = rows.select("source", "query", "page", F.posexplode(F.col(f"p.{_LISTS[source]}")).alias("pos", "r"))
    f = _fields(source, F.col("r"))
    return flat.select("source", "query", "page", "pos", normalize_doi(f["doi"]).alias("doi"), *(f[c].alias(c) for c in ("pmid", "title", "year", "abstract")))


def all_citations(answers: DataFrame, page_size: int, queries: int) -> DataFrame:
    """Every service's citations, each query cut to its share of the page: p // n, and one more for the first p % n."""
    out = None
    for s in SCHEMAS:
        c = citations(answers, s)
        out = c if out is None else out.unionByName(c)
    share = F.lit(page_size // queries) + (F.col("query") < page_size % queries).cast("int")
    return out.where(F.col("pos") < share)


def failures(answers: DataFrame) -> DataFrame:
    """(source, query, page, code) of pages that did not come."""
    s = F.col("status")
    code = F.when(s.isin(401, 402), "paywalled").when(s == 403, "blocked").when(s == 429, "rate_limited").otherwise("retrieval_error")
    return answers.where(s != 200).select("source", "query", "page", code.alias("code"))


def enriched(rows: DataFrame, key: str, lookups: list[DataFrame], columns: list[str]) -> DataFrame:
    """Missing columns filled from the first lookup that has a value."""
    from ..operators.joins import overlay

    base = rows.select(key, *columns)
    filled = overlay(base, key, [base, *lookups], columns)
    return rows.drop(*columns).join(filled, key)


# Fixed formats: the answers of the two PubMed calls that matter, and of the web search.
PUBMED_RESULT = "result map<string,string>"
PUBMED_ITEM = "title string, pubdate string, articleids array<struct<idtype:string,value:string>>"
WEB_SEARCH = "data array<struct<title:string,url:string,description:string>>"


def pubmed_citations(answers: DataFrame) -> DataFrame:
    """The same columns as ``citations`` from stored PubMed answers: rows of source ``pubmed`` (a summary) and ``pubmed_abstracts`` (XML).

    A summary is a map from PMID to record, with the order under ``uids``. Abstracts join by page and PMID; a page whose
    abstracts did not come keeps its records.
    """
    from .files import pubmed_abstracts

    page = ["query", "page"]
    ok = answers.where("status = 200")
    found = ok.where("source = 'pubmed'").select(*page, F.from_json("payload", PUBMED_RESULT)["result"].alias("r"))
    each = found.select(*page, F.posexplode(F.from_json(F.col("r")["uids"], "array<string>")).alias("pos", "pmid"), "r")
    item = F.from_json(F.col("r")[F.col("pmid")], PUBMED_ITEM)
    doi = F.get(F.filter(item["articleids"], lambda a: a["idtype"] == "doi"), F.lit(0))["value"]
    rows = each.select(F.lit("pubmed").alias("source"), *page, "pos", normalize_doi(doi).alias("doi"), "pmid", F.coalesce(F.nullif(item["title"], F.lit("")), F.concat(F.lit("PubMed record "), F.col("pmid"))).alias("title"), year_of(item["pubdate"]).alias("year"))
    texts = ok.where("source = 'pubmed_abstracts'").select(*page, F.explode(pubmed_abstracts(F.col("payload"))).alias("a")).select(*page, F.col("a.pmid").alias("pmid"), F.col("a.abstract").alias("abstract"))
    return rows.join(texts.dropDuplicates([*page, "pmid"]), [*page, "pmid"], "left").select("source", *page, "pos", "doi", "pmid", "title", "year", "abstract")


def web_citations(answers: DataFrame) -> DataFrame:
    """Citations of a stored web search: only its first page counts, results need a title and an address."""
    rows = answers.where("source = 'firecrawl' AND status = 200 AND page = 0").select("source", "query", "page", F.posexplode(F.from_json("payload", WEB_SEARCH)["data"]).alias("pos", "r"))
    none = F.lit(None).cast("string")
    kept = rows.where("coalesce(r.title, '') <> '' AND coalesce(r.url, '') <> ''")
    return kept.select("source", "query", "page", "pos", none.alias("doi"), none.alias("pmid"), F.col("r.title").alias("title"), F.lit(None).cast("int").alias("year"), F.col("r.description").alias("abstract"))


PRIMARY, FALLBACK = ["pubmed", "europe_pmc", "openalex", "crossref"], ["semantic_scholar", "firecrawl"]


def candidate_page(answers: DataFrame, page: int, page_size: int, queries: int, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """Citations of one page from the connectors of ``mode`` (primary, fallback, all), and the failures.

    A query gets p // n results, and one more for the first p % n. A connector whose page failed is cut off at the first
    query that failed: what its earlier queries brought stays, later ones do not count.
    """
    names = {"primary": PRIMARY, "fallback": FALLBACK, "all": PRIMARY + FALLBACK}[mode]
    own = F.when(F.col("source") == "pubmed_abstracts", "pubmed").otherwise(F.col("source"))
    rows = answers.where((F.col("page") == page) & own.isin(names))
    failed = rows.where("status <> 200 AND source <> 'pubmed_abstracts'")
    stop = failed.groupBy("source").agg(F.min("query").alias("stop"))
    found = None
    for name in names:
        one = pubmed_citations(rows) if name == "pubmed" else web_citations(rows) if name == "firecrawl" else citations(rows, name)
        found = one if found is None else found.unionByName(one)
    share = F.lit(page_size // queries) + (F.col("query") < page_size % queries).cast("int")
    kept = found.where(F.col("pos") < share).join(F.broadcast(stop), "source", "left").where("stop IS NULL OR query < stop").drop("stop")  # one row a connector
    return kept, failures(failed)


def refilled(primary: DataFrame, fallback: DataFrame, key: str, wanted: int) -> DataFrame:
    """Primary citations, and where they are fewer than ``wanted``, as many fallback ones with other keys as are missing, by place."""
    short = wanted - primary.count()
    if short <= 0:
        return primary
    rest = fallback.join(primary.select(key), key, "left_anti")
    return primary.unionByName(rest.orderBy("query", "pos", key).limit(short).select(*primary.columns))


def collected(answers: DataFrame, page_size: int, queries: int, names: list[str]) -> DataFrame:
    """The citations of all pages of some connectors, each query cut to its share of the page, with ``collector``, its place in the list."""
    found = None
    for i, name in enumerate(names):
        one = pubmed_citations(answers) if name == "pubmed" else web_citations(answers) if name == "firecrawl" else citations(answers, name)
        one = one.withColumn("collector", F.lit(i))
        found = one if found is None else found.unionByName(one)
    share = F.lit(page_size // queries) + (F.col("query") < page_size % queries).cast("int")
    return found.where((F.col("pos") < share) & (F.col("query") < queries))


def citation_key() -> Column:
    """What makes two citations one: the DOI, else the PMID, else the title without regard to case."""
    return F.coalesce(F.nullif("doi", F.lit("")), F.concat(F.lit("pmid:"), F.nullif(F.trim("pmid"), F.lit(""))), F.lower(F.trim("title")))


def candidate_run(answers: DataFrame, page_size: int, queries: int, target: int, max_pages: int, fallback_pages: int = 2) -> dict[str, DataFrame]:
    """A whole run over stored answers: ``candidates`` (the first of each key, in order, ``target`` at most), ``pages`` and ``failures``.

    The primary connectors are asked page by page, then the fallback ones, until the target is reached or a page brings
    nothing new, which ends its group. A connector is off from its first failure on: that query's answer, later queries and
    all later pages of the run do not count, and only this failure is told. Pages have slot, mode, page, raw, new and total;
    the last page's ``stop`` says why the run ended.

    Cases: pages without answers are empty pages; answers beyond a page's queries do not count; repeated answers count
    once more as raw; without answers there is one empty page of each group.
    """
    own = F.when(F.col("source") == "pubmed_abstracts", "pubmed").otherwise(F.col("source"))
    names = {"primary": PRIMARY, "fallback": FALLBACK}
    spark = answers.sparkSession
    asked = answers.where((F.col("query") < queries) & own.isin(*PRIMARY, *FALLBACK))
    broken = asked.where("status <> 200 AND source <> 'pubmed_abstracts'").withColumn("at", F.struct("page", "query"))
    off = broken.groupBy("source").agg(F.min("at").alias("off"), F.min_by("status", "at").alias("status"))
    rows = None
    for mode, limit, base in (("primary", max_pages, 0), ("fallback", min(fallback_pages, max_pages), max_pages)):
        one = collected(asked, page_size, queries, names[mode]).where(F.col("page") < limit)
        one = one.join(F.broadcast(off.select("source", "off")), "source", "left").where(F.col("off").isNull() | (F.struct("page", "query") < F.col("off"))).drop("off")  # one row a connector
        one = one.withColumn("mode", F.lit(mode)).withColumn("slot", F.col("page") + base)
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.withColumn("key", citation_key()).withColumn("at", F.struct("slot", "collector", "query", "pos"))

    def report(some: DataFrame, mode: str, limit: int, base: int, before) -> DataFrame:
        """The pages of a group in order, and whether the run ends after each; few rows, one for each page that may be asked."""
        first = some.groupBy("key").agg(F.min("at.slot").alias("slot")).groupBy("slot").agg(F.count("*").alias("new"))
        raw = some.groupBy("slot").agg(F.count("*").alias("raw"))
        pages = spark.range(base, base + limit).select(F.col("id").cast("int").alias("slot")).join(raw, "slot", "left").join(first, "slot", "left")
        order = Window.orderBy("slot")
        pages = pages.select("slot", F.lit(mode).alias("mode"), (F.col("slot") - base).alias("page"), F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("new", F.lit(0)).alias("new"))
        pages = pages.withColumn("total", before + F.sum("new").over(order))
        stop = F.when(F.col("total") >= target, "target_reached").when(F.col("new") == 0, "no_new_unique_candidates")
        pages = pages.withColumn("stop", stop)
        return pages.withColumn("ended", F.max(F.col("stop").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("coalesce(ended, 0) = 0").drop("ended")

    primary = rows.where("mode = 'primary'")
    pages = report(primary, "primary", max_pages, 0, F.lit(0))
    done = pages.agg(F.max("slot").alias("last"), F.max("total").alias("total"), F.max((F.col("stop") == "target_reached").cast("int")).alias("full")).first()  # one row
    kept = primary.where(F.col("slot") <= (-1 if done.last is None else done.last))
    if not done.full:
        rest = rows.where("mode = 'fallback'").join(kept.select(F.col("key").alias("known")).distinct(), F.col("key") == F.col("known"), "left_anti")
        more = report(rest, "fallback", min(fallback_pages, max_pages), max_pages, F.lit(done.total or 0))
        last = more.agg(F.max("slot")).first()[0]
        raw = rows.where("mode = 'fallback'").groupBy("slot").agg(F.count("*").alias("all"))
        more = more.join(raw, "slot", "left").withColumn("raw", F.coalesce("all", F.lit(0))).drop("all")
        pages = pages.unionByName(more)
        kept = kept.unionByName(rows.where(F.col("mode") == "fallback").where(F.col("slot") <= (-1 if last is None else last)))
    else:
        last = done.last
    first = kept.groupBy("key").agg(F.min("at").alias("at"), F.min_by(F.struct("source", "query", "page", "doi", "pmid", "title", "year", "abstract"), "at").alias("c"))
    candidates = first.orderBy("at").limit(target).select("key", "c.*", F.col("at.slot").alias("slot"))
    slot = F.when(F.col("source").isin(*FALLBACK), F.col("off.page") + max_pages).otherwise(F.col("off.page"))
    told = off.where(slot <= (-1 if last is None else last)) if last is not None else off.limit(0)
    told = told.where(~F.col("source").isin(*PRIMARY) | (F.col("off.page") <= (-1 if done.last is None else done.last)))
    return {"candidates": candidates, "pages": pages, "failures": failures(told.select("source", "off.query", "off.page", "status"))}
