"""Open-access addresses from the stored answers of four services, and the retrieval cascade over stored attempts.

Answers and attempts are input tables, as everywhere in this library: (source_id, doi, service, payload) rows hold JSON
of the public services, attempts hold what a fetcher got. Both the ranking and the outcome are plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let, normalize_doi

# Formats of the services (the fields that are used), versions by preference, ISSNs by journal code.
_PLACE = "struct<url:string,url_for_pdf:string,url_for_landing_page:string,landing_page_url:string,pdf_url:string,version:string,host_type:string,license:string>"
UNPAYWALL = f"is_oa boolean, oa_status string, best_oa_location {_PLACE}, oa_locations array<{_PLACE}>"
OPENALEX = f"open_access struct<oa_status:string,oa_url:string>, best_oa_location {_PLACE}, primary_location {_PLACE}, locations array<{_PLACE}>"
CROSSREF = "link array<struct<URL:string,`content-type`:string>>, license array<struct<URL:string>>"
VERSIONS = ["publishedVersion", "acceptedVersion", "submittedVersion"]
ISSN = {"nu": "2072-6643"}
MDPI_FORMS = [("", "publisher_page", "html"), ("/xml", "mdpi_xml", "xml"), ("/pdf?download=1", "mdpi_pdf", "pdf"), ("/pdf", "mdpi_pdf", "pdf")]


def is_url(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike("^https?://"), F.lit(False))


def pmc_id(url: Column) -> Column:
    """PMC123 of an address: written out, or a number of five digits or more on a PMC host or path."""
    named = F.upper(F.regexp_extract(url, r"(?i)/(?:articles?/)?(PMC\d+)", 1))
    number = F.regexp_extract(url, r"(?i)/(?:articles?/)?(\d{5,})(?:/|$)", 1)
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(named != "", named).when((number != "") & (host.contains("pmc") | path.contains("/pmc/")), F.concat(F.lit("PMC"), number))


def mdpi_page(doi: Column) -> Column:
    """The article address that a DOI 10.3390/<journal><volume><issue><article> stands for; null for other journals."""
    d = normalize_doi(doi)
    part = lambda k: F.regexp_extract(d, r"^10\.3390/([a-z]+)(\d{2})(\d{2})(\d+)$", k)
    issn = F.element_at(F.create_map(*(F.lit(x) for kv in ISSN.items() for x in kv)), F.nullif(part(1), F.lit("")))
    number = lambda k: F.when(part(k) != "", part(k)).try_cast("long").cast("string")
    return F.when(issn.isNotNull(), F.concat_ws("/", F.lit("https://www.mdpi.com"), issn, number(2), number(3), number(4)))


def method_of(url: Column, content_type: Column, default: str) -> Column:
    u, t = F.lower(url), F.lower(F.coalesce(content_type, F.lit("")))
    mdpi = u.contains("mdpi.com")
    return (
        F.when(u.contains("onlinelibrary.wiley.com") & u.contains("full-xml"), "wiley_full_xml")
        .when(mdpi & F.regexp_like(u, F.lit("/xml/*$")), "mdpi_xml")
        .when(mdpi & u.contains("/pdf"), "mdpi_pdf")
        .when(t.contains("xml") | u.contains("full-xml"), "crossref_full_xml")
        .when(t.contains("pdf") | u.contains("/pdf") | u.endswith(".pdf"), default if default.endswith("_pdf") else "crossref_pdf")
        .otherwise(default)
    )


def _candidate(url: Column, method, kind, license_: Column, tier: int, *order) -> Column:
    rank = [*(o if isinstance(o, Column) else F.lit(o) for o in order), F.lit(0), F.lit(0), F.lit(0)][:3]
    put = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(tier).alias("tier"), *(r.cast("int").alias(f"o{i}") for i, r in enumerate(rank)), url.alias("url"), put(method).alias("method"), put(kind).alias("kind"), license_.cast("string").alias("license"))


_NONE = "array<struct<tier:int,o0:int,o1:int,o2:int,url:string,method:string,kind:string,license:string>>"


def _unpaywall(p: Column) -> Column:
    places = F.filter(F.concat(F.array(p["best_oa_location"]), F.coalesce(p["oa_locations"], F.array().cast(f"array<{_PLACE}>"))), lambda x: x.isNotNull())

    def both(x, i):
        version = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, VERSIONS)), x["version"]), F.lit(0).cast("long")) - 1, F.lit(len(VERSIONS)))
        landing = F.coalesce(F.nullif(x["url_for_landing_page"], F.lit("")), x["url"])
        return F.array(_candidate(x["url_for_pdf"], "unpaywall_pdf", "pdf", x["license"], 2, version, 0, i), _candidate(landing, "unpaywall_landing_page", "html", x["license"], 2, version, 1, i))

    return F.when(p["is_oa"], F.flatten(F.transform(places, both)))


def _openalex(p: Column) -> Column:
    oa = p["open_access"]
    places = F.filter(F.concat(F.array(p["best_oa_location"], p["primary_location"]), F.coalesce(p["locations"], F.array().cast(f"array<{_PLACE}>"))), lambda x: x.isNotNull())

    def both(x, i):
        held = F.coalesce(F.nullif(x["license"], F.lit("")), oa["oa_status"])
        return F.array(_candidate(F.concat(F.lit("pmc:"), pmc_id(x["landing_page_url"])), "pmc_oa_xml", "pmc", held, 3, i, 0), _candidate(F.nullif(x["pdf_url"], F.lit("")), method_of(x["pdf_url"], F.lit("application/pdf"), "openalex_pdf"), "pdf", held, 3, i, 1))

    url = oa["oa_url"]
    dot = url.contains(".pdf")
    last = _candidate(F.when(is_url(url), url), method_of(url, F.when(dot, "application/pdf"), "openalex_pdf"), F.when(dot | url.contains("/pdf"), "pdf").otherwise("html"), oa["oa_status"], 3, 1 << 30, 0)
    return F.concat(F.flatten(F.transform(places, both)), F.array(last))


def _crossref(p: Column) -> Column:
    held = F.get(p["license"], F.lit(0))["URL"]

    def one(x, i):
        elsewhere = F.lower(F.regexp_extract(x["URL"], r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)) == "api.elsevier.com"
        method = method_of(x["URL"], x["content-type"], "crossref_pdf")
        return _candidate(F.when(~elsewhere, F.nullif(x["URL"], F.lit(""))), method, F.when(method.isin("crossref_full_xml", "wiley_full_xml"), "xml").otherwise("pdf"), held, 4, i)

    return F.transform(F.coalesce(p["link"], F.array().cast("array<struct<URL:string,`content-type`:string>>")), one)


def resolved(sources: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidate addresses (source_id, rank, url, method, kind, license) of sources (source_id, doi, pmcid), each address once.

    ``answers``: (source_id, service, payload). PMC comes first, then addresses that follow from the DOI, then Unpaywall
    (version, PDF before page, place), OpenAlex and Crossref in the order of the answer. An address keeps its first place.
    """
    doi = F.nullif(F.coalesce(normalize_doi(F.col("doi")), F.lit("")), F.lit(""))
    page = mdpi_page(F.col("doi"))
    no = F.lit(None).cast("string")
    own = F.concat(F.array(_candidate(F.concat(F.lit("pmc:"), F.nullif(F.col("pmcid"), F.lit(""))), "pmc_oa_xml", "pmc", no, 0)), F.array(*(_candidate(F.concat(page, F.lit(tail)), m, k, no, 1, i) for i, (tail, m, k) in enumerate(MDPI_FORMS))))
    asked = answers.join(sources.where(doi.isNotNull()).select("source_id"), "source_id", "left_semi")
    services = {"unpaywall": (UNPAYWALL, _unpaywall), "openalex": (OPENALEX, _openalex), "crossref": (CROSSREF, _crossref)}
    # one parse of each answer: a generator keeps the parsed value from being copied into the expressions above it
    parsed = F.struct(*(F.when(F.col("service") == s, F.from_json("payload", schema)).alias(s) for s, (schema, _) in services.items()))
    asked = asked.where(F.col("service").isin(*services)).select("source_id", "service", F.explode(F.array(parsed)).alias("p"))
    of = F.lit(None).cast(_NONE)
    for service, (_, read) in services.items():
        of = F.when(F.col("service") == service, read(F.col("p")[service])).otherwise(of)
    told = asked.select("source_id", F.explode(of).alias("c"))
    every = sources.select("source_id", F.explode(own).alias("c")).unionByName(told).select("source_id", "c.*").where("coalesce(url, '') <> ''")
    every = every.where(is_url(F.col("url")) | F.col("url").startswith("pmc:"))
    order = ["tier", "o0", "o1", "o2"]
    # one shuffle: a source's addresses are brought together once, and the first place of each is found there
    whole = every.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("url", F.struct(*order, "method", "kind", "license").alias("c")))).alias("all"))
    once = let(F.col("all"), lambda s: F.filter(s, lambda x, i: (i == 0) | (x["url"] != F.get(s, i - 1)["url"])))
    ranked = whole.select("source_id", F.sort_array(F.transform(once, lambda x: F.struct(x["c"].alias("c"), x["url"].alias("url")))).alias("all"))
    flat = ranked.select("source_id", F.posexplode("all").alias("i", "x"))
    return flat.select("source_id", (F.col("i") + 1).alias("rank"), F.col("x.url").alias("url"), F.col("x.c.method").alias("method"), F.col("x.c.kind").alias("kind"), F.col("x.c.license").alias("license"))


#: Stages of the cascade, in order, and failures from the most to the least telling (fixed values).
STAGES = ["existing_body", "publisher_page", "resolved", "europe_pmc", "elsevier", "firecrawl"]
TERMINAL = ["blocked_by_cloudflare", "paywalled", "pdf_parse_failed", "blocked", "retrieval_error"]


def cascade(sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """One record for each source: status, stage, url, text and n_attempts.

    ``sources``: (source_id, abstract, page_summary); ``attempts``: (source_id, stage, rank, status, url, text). The first
    attempt by stage and rank that found a text wins and ends the cascade: later ones do not count. Without one, the most
    telling failure is the outcome; without a failure, what the source itself holds: abstract_only, page_summary_only;
    then no_oa_location if nothing was tried, else not_available.
    """
    place = F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0).cast("long")), F.lit(len(STAGES) + 1)).alias("s"), "rank")
    hit = (F.col("status") == "found") & (F.length(F.coalesce("text", F.lit(""))) > 0)
    tried = attempts.withColumn("_place", place).withColumn("_hit", hit)
    worst = F.nullif(F.array_position(F.array(*map(F.lit, TERMINAL)), F.col("status")), F.lit(0).cast("long"))
    best = tried.groupBy("source_id").agg(
        F.min(F.when(F.col("_hit"), F.struct("_place", "stage", "url", "text"))).alias("found"), F.min(F.when(worst.isNotNull(), F.struct(worst.alias("w"), "_place", "stage", "url", "status"))).alias("failed"), F.count("*").alias("n_all"),
    )
    used = tried.join(best.select("source_id", F.col("found._place").alias("_end")), "source_id").where("_end IS NULL OR _place <= _end").groupBy("source_id").agg(F.count("*").alias("n_attempts"))
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    status = (
        F.when(F.col("found").isNotNull(), "full_text_found").when(F.col("failed").isNotNull(), F.col("failed.status")).when(filled("abstract"), "abstract_only").when(filled("page_summary"), "page_summary_only")
        .when(F.col("n_attempts").isNull(), "no_oa_location").otherwise("not_available")
    )
    out = sources.join(best.drop("n_all"), "source_id", "left").join(used, "source_id", "left")
    return out.select("source_id", status.alias("status"), F.coalesce("found.stage", "failed.stage").alias("stage"), F.coalesce("found.url", "failed.url").alias("url"), F.col("found.text").alias("text"), F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"))


def reached(payload: Column, path: str) -> Column:
    """The text at a path of a JSON document ($.a.b, indexes as [0]); null where it is absent or the document is broken."""
    return F.try_variant_get(F.try_parse_json(payload), path, "string")
