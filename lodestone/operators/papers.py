"""Bodies of papers, decided on an index of headings: what a validator may quote, and the context for extraction.

``heading_index`` cuts each text once, where a word of the heading table stands, into rows: the piece, its place and what
stands around the word. Rows add up to the text, so the index is linear in it. All rules (abstracts, introductions,
references, conclusions, sections) are comparisons of places in windows over a document's rows; only the stretch that is
chosen is cut out of the text, once for each stage.

Cases: null texts have no rows and give null; a text without headings is one row; repeated and listed headings are told by
what follows them; ids name one paper each; very long texts and texts of nothing but headings are linear; an empty table
gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let, truncate_words

#: Characters that a body must keep, that stand before its references or headings, of a head, and where an abstract begins at the latest.
LEAST, BEFORE_REFERENCES, BEFORE_HEADING, HEAD, ABSTRACT_BY = 500, 500, 300, 20_000, 5_000

# Words of scholarly headings; those of SPACED may be set with spaced letters.
SPACED = ["introduction", "background", "methods", "study design", "participants", "results", "discussion", "conclusions", "conclusion"]
PLAIN = ["method", "result", "references", "bibliography", "keywords", "keyword", "abstract", "summary", "streszczenie", r"wst[eę]p", r"s[lł]owa\s+kluczowe", r"materials?\s+(?:and|&)\s+methods?"]
METHODS, RESULTS, DISCUSSION = ["materialsandmethods", "methods", "studydesign", "participants"], ["results"], ["discussion", "conclusion", "conclusions"]
STRUCTURED = ["background", "materialsandmethods", "methods", "studydesign", "participants"]
FOLLOWS = ["keyword", "keywords", "introduction", "background", "method", "methods", "materials and methods"]
PREAMBLES = {"abstract": [*FOLLOWS, "study design"], "summary": [*FOLLOWS, "study design"], "streszczenie": ["słowa kluczowe", "slowa kluczowe", "wstęp", "wstep", "introduction", "background"]}
SECTIONS = ["introduction", "background", "method", "methods", "materials and methods", "result", "results", "discussion", "conclusion", "conclusions"]
PRIORITY = ["methods", "method", "materials and methods", "results", "result", "discussion", "conclusion", "conclusions", "introduction", "background"]
INLINE = r"^(?:Methods|Results|Discussion|Conclusions|conclusions)\b(?=\s+(?:Criteria|Search|Types|Data|Description|Effects|Summary|Overall|In\b))"
OUTCOMES = ["participants", "subjects", "randomized", "consumed", "ingested", "supplement", "outcome"]
NUMBERED_TITLE = r"(?:^|\s)1\.\s+[A-Z][A-Za-zÀ-ÖØ-öø-ÿĀ-ž][^.!?]{2,160}(?=\s+[A-Z])"
AUTHORS = {"References": r"^\s+[A-Z][A-Za-z'’-]+(?:\s+[A-Z]{1,4})?,", "Bibliography": r"^\s+[A-Z][A-Za-z'’-]+"}
LISTS = ["results discussion references", "references references export references"]
PREVIEWS = [("this is a preview of subscription content",), ("restricted access", "purchase article")]

_EDGE = r"[\p{L}\p{N}_]"
_WORD = "(?i:" + "|".join([*(r"\s+".join(r"\s*".join(w) for w in s.split()) for s in SPACED), *PLAIN]) + f")(?!{_EDGE})"
# cheap tests first: the look back over "materials and" is made only where a heading's word stands
_CUT = rf"(?=[abcdikmprswABCDIKMPRSW])(?<!{_EDGE})(?={_WORD})(?<!(?i:materials?)\s{{1,9}}(?i:and|&)\s{{1,9}})"
#: Characters of a piece that are looked at around its word.
_NEAR = 240


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_preview(text: Column) -> Column:
    """Whether a publisher's page shows a preview only, by its first 10,000 characters."""
    return let(F.lower(F.substring(text, 1, 10_000)), lambda low: F.array_max(F.array(*(F.array_min(F.array(*(F.contains(low, F.lit(w)) for w in words))) for words in PREVIEWS))))


def heading_index(papers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pieces of each text: id, i, piece, at (its place, from 0), word (the heading that it begins with, as written in lower case), label (the
    word without white space), number (characters of a number before the word), spaced, first, line, listed_at."""
    rows = papers.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), _CUT)).alias("i", "piece"))
    order = Window.partitionBy("id").orderBy("i")
    rows = rows.select("*", (F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("at"), F.lag("piece").over(order).alias("_before"), F.lead("piece").over(order).alias("_next"))
    near = F.substring("piece", 1, _NEAR)
    word = F.lower(F.regexp_extract(near, f"^{_WORD}", 0))
    # what stands before the word; an x where more text does
    tail = F.when(F.col("i") == 0, "").otherwise(F.concat(F.when((F.col("i") > 1) | (F.length("_before") > _NEAR), "x").otherwise(""), F.right("_before", F.lit(_NEAR))))
    rest = F.substring(near, F.length(word) + 1, F.lit(_NEAR))
    rows = rows.select("id", "i", "piece", "at", word.alias("word"), F.regexp_replace(word, r"\s+", "").alias("label"), tail.alias("tail"), rest.alias("rest"), F.col("_next").isNull().alias("final"), F.lower(F.substring("piece", 1, 40)).alias("_low"), F.lower(F.substring("_next", 1, 40)).alias("_low1"))
    rows = rows.withColumn("_label2", F.lead("label", 2).over(order))
    blank_after = F.col("rest").rlike(r"^[^\S\n]*\n") | F.col("final") & F.col("rest").rlike(r"^\s*\z")
    listed = F.when((F.col("_low") == "results ") & (F.col("_low1") == "discussion ") & (F.col("_label2") == "references"), F.length(F.lit(LISTS[0])))
    listed = listed.when((F.col("_low") == "references ") & (F.col("_low1") == "references export ") & (F.col("_label2") == "references"), F.length(F.lit(LISTS[1])))
    return rows.select(
        "id", "i", "piece", "at", "word", "label", "rest",
        ((F.col("at") == 0) | F.col("tail").rlike(r"\s\z")).alias("apart"),  # white space stands before the word
        F.length(F.regexp_extract("tail", r"(?:^|\s)(\d+(?:\.\d+)*[.)]?\s*)\z", 1)).alias("number"),
        F.when(F.col("tail").rlike(r"(?:^|\n)\s*(?:\d+(?:\.\d+)*[.)]?\s*)?\z") & blank_after, F.length(F.regexp_extract("tail", r"(?:^|\n)(\s*(?:\d+(?:\.\d+)*[.)]?\s*)?)\z", 1))).alias("line"),  # a line of its own: characters of it before the word
        F.col("tail").rlike(r"(?:^|\n)\s*(?:\d+[.)]?\s*)?\z").alias("plain_line"),
        (F.col("rest").rlike(r"^\s") | F.col("final") & (F.col("rest") == "")).alias("ends"),
        F.col("rest").startswith(":").alias("colon"),
        F.col("tail").rlike(r"(?:^|\s)1(?:\.0)?[.)]?\s+\z").alias("one"),
        F.col("tail").rlike(r"\bAuthors' \z").alias("authors"),
        F.coalesce(F.col("at") + listed, F.lit(1 << 40)).alias("listed"),
    )


def _flags(rows: DataFrame) -> DataFrame:
    """The places of each kind of heading, null where a row is none."""
    at, label, word = F.col("at"), F.col("label"), F.col("word")
    put = lambda test, place=at: F.when(test, place)
    heading = (F.col("apart") | (F.col("number") > 0)) & (F.col("ends") | F.col("colon"))
    start = at - F.col("number") - F.when((at > F.col("number")) & (F.col("apart") | (F.col("number") > 0)), 1).otherwise(0)
    refs = put(label.isin("references", "bibliography") & F.col("plain_line") & F.col("line").isNotNull(), at - F.col("line"))
    refs = F.coalesce(refs, *(put(F.col("piece").startswith(w) & F.col("rest").rlike(p)) for w, p in AUTHORS.items()))
    spoken = F.regexp_replace(word, r"\s+", " ")
    return rows.select(
        "id", "i", "piece", "at", "listed", refs.alias("refs"), put(word.isin("conclusion", "conclusions") & F.col("line").isNotNull(), at - F.col("line")).alias("closing"),
        put(heading & label.isin(*METHODS, "materialsandmethod", "materialandmethods", "materialandmethod", "materials&methods"), start).alias("methods"), put(heading & label.isin(*RESULTS), start).alias("results"), put(heading & label.isin(*DISCUSSION), start).alias("discussion"),
        put(label.isin(*STRUCTURED) & F.col("apart") & F.col("rest").rlike(r"^\s")).alias("structured"),
        put((word == "results") & F.col("apart") & F.col("rest").rlike(r"^\s")).alias("told"), put(word.isin(*DISCUSSION) & F.col("apart") & F.col("rest").rlike(r"^\s")).alias("discussed"),
        put(((label == "introduction") | label.isin("wstęp", "wstep")) & F.col("apart") & F.col("ends"), at - F.when(F.col("one") & (word == "introduction"), F.col("number")).otherwise(0)).alias("intro"),
        *(put(spoken.isin(*follows)).alias(f"after_{k}") for k, follows in PREAMBLES.items()),
        *(put((word == k) & F.col("rest").rlike(r"^\s")).alias(k) for k in PREAMBLES),
    )


def _all():
    """Over all rows of a document."""
    return Window.partitionBy("id")


def _preamble_end(rows: DataFrame, base: str, preview: str, to: str) -> DataFrame:
    """``to``: where the text goes on after an abstract that begins within 5,000 characters of ``base``; ``base`` where there is none."""
    first = {k: F.min(F.when(F.col(k) >= F.col(base), F.col(k))).over(_all()).alias(f"_{k}") for k in PREAMBLES}
    rows = rows.select("*", *first.values())
    ends = {k: F.min(F.when(F.col(f"after_{k}") > F.col(f"_{k}"), F.col(f"after_{k}"))).over(_all()).alias(f"_end_{k}") for k in PREAMBLES}
    rows = rows.select("*", *ends.values())
    good = [F.when((F.col(f"_{k}") - F.col(base) < ABSTRACT_BY) & (F.col(f"_end_{k}") - F.col(base) < HEAD), F.col(f"_end_{k}")) for k in PREAMBLES]
    return rows.withColumn(to, F.when(F.col(preview), F.col(base)).otherwise(F.greatest(F.col(base), *good))).drop(*(f"_{k}" for k in PREAMBLES), *(f"_end_{k}" for k in PREAMBLES))


def _least(test: Column, value: Column) -> Column:
    return F.min(F.when(test, value)).over(_all())


def _most(test: Column, value: Column) -> Column:
    return F.max(F.when(test, value)).over(_all())


def sanitized(papers: DataFrame, id_col: str = "source_id", text_col: str = "text", title_col: str = "title", abstract_col: str = "abstract") -> DataFrame:
    """(id, text, stage, preview): what a validator may quote of each paper, or null and the first 4,000 characters for inspection.

    Title and abstract go, then an abstract-like preamble. The body is what is left if the abstract was found; else it
    begins at the introduction, at the first structured heading that results and a discussion follow, or at the first
    section of a report. References and the terminal conclusion go; 500 characters must stay.
    """
    from .evidence import remove_spans

    bare = papers.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("whole"), F.col(title_col).alias("title"), F.col(abstract_col).alias("abstract"), remove_spans(F.col(text_col), F.col(abstract_col)).alias("bare"))
    bare = bare.select("id", ((F.trim(F.coalesce("abstract", F.lit(""))) != "") & (F.col("bare") != F.col("whole"))).alias("removed"), remove_spans(F.col("bare"), F.col("title")).alias("text"))
    # what is to be known of the first characters goes with the first piece, the flag of the abstract in its number
    rows = heading_index(bare.select(F.struct("id", "removed").alias("of"), "text"), "of", "text")
    rows = _flags(rows).withColumn("n", F.sum(F.length("piece")).over(_all()))
    head = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at") < HEAD + 10_000, F.struct("i", F.substring("piece", 1, HEAD + 10_000).alias("p")))).over(_all())), lambda x: x["p"]), ""), 1, HEAD + 10_000)
    rows = rows.withColumn("head", F.when(F.col("i") == 0, head)).withColumn("zero", F.lit(0).cast("long"))
    over = lambda c: F.max(F.when(F.col("i") == 0, c)).over(_all())
    rows = rows.withColumn("preview0", over(is_preview(F.col("head"))))
    rows = _preamble_end(rows, "zero", "preview0", "p")
    plain_head = F.substring(F.col("head"), (F.col("p") + 1).cast("int"), F.lit(HEAD))
    rows = rows.withColumn("preview", over(is_preview(plain_head))).withColumn("numbered", over(F.nullif(F.regexp_instr(plain_head, F.lit(NUMBERED_TITLE)), F.lit(0))))
    rows = _preamble_end(rows, "p", "preview", "q").drop("head")
    rows = rows.withColumn("end_q", F.coalesce(_least(F.col("refs") - F.col("q") >= BEFORE_REFERENCES, F.col("refs")), F.col("n")))
    within = lambda c: F.col(c) < F.col("end_q")
    later = Window.partitionBy("id").orderBy(F.desc("i"))
    rows = rows.select(
        "*", F.least(_least((F.col("intro") >= F.col("p")) & (F.col("intro") - F.col("p") < HEAD), F.col("intro")), F.col("p") + F.col("numbered") - 1).alias("s_intro"), F.min("listed").over(later).alias("next_listed"), _most(within("told"), F.col("told")).alias("last_told"), _most(within("discussed"), F.col("discussed")).alias("last_discussed"),
        _least(within("methods") & (F.col("methods") - F.col("q") >= BEFORE_HEADING), F.col("methods")).alias("m"), _least(within("results") & (F.col("results") - F.col("q") >= BEFORE_HEADING), F.col("results")).alias("r"), _least(within("discussion") & (F.col("discussion") - F.col("q") >= BEFORE_HEADING), F.col("discussion")).alias("d"),
        _most(within("methods"), F.col("methods")).alias("last_m"), _most(within("results"), F.col("results")).alias("last_r"), _most(within("discussion"), F.col("discussion")).alias("last_d"),
    )
    c = F.col("structured")
    good = within("structured") & (c - 1 - F.col("q") >= BEFORE_HEADING) & (F.col("next_listed") > c + 500) & (F.col("last_told") >= c + 800) & (F.col("last_discussed") >= c + 1_500) & (F.col("end_q") - c >= 2_000)
    rows = rows.withColumn("s_structure", F.when(~F.col("preview"), _least(good, c))).withColumn("s_sections", F.when(~F.col("preview"), F.least("m", "r", "d")))
    starts = {"abstract_removed": "p", "introduction": "s_intro", "structure": "s_structure", "sections": "s_sections"}
    for stage, s in starts.items():
        end = F.col("end_q") if stage in ("structure", "sections") else F.coalesce(_least(F.col("refs") - F.col(s) >= BEFORE_REFERENCES, F.col("refs")), F.col("n"))
        rows = rows.withColumn(f"e_{stage}", end)
    for stage, s in starts.items():
        e = F.col(f"e_{stage}")
        rows = rows.withColumn(f"c_{stage}", _most((F.col("closing") > F.col(s)) & (F.col("closing") < e), F.col("closing")))
    kept = [*starts.values(), "last_m", "last_r", "last_d", "end_q", *(f"{x}_{s}" for s in starts for x in "ec")]
    one = rows.groupBy("id").agg(*(F.max(k).alias(k) for k in dict.fromkeys(kept)), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "").alias("text"))

    def stretch(stage, s):
        end = F.when(F.col(f"c_{stage}") - F.col(s) >= 0.45 * (F.col(f"e_{stage}") - F.col(s)), F.col(f"c_{stage}")).otherwise(F.col(f"e_{stage}"))
        return _strip(F.substring("text", (F.col(s) + 1).cast("int"), (end - F.col(s)).cast("int")))

    body = _strip(F.substring("text", (F.col("s_sections") + 1).cast("int"), (F.col("end_q") - F.col("s_sections")).cast("int")))
    has = lambda c: F.coalesce(F.col(c) >= F.col("s_sections"), F.lit(False))
    report = let(F.struct(F.length(body).alias("n"), F.regexp_like(F.lower(body), F.lit("|".join(OUTCOMES))).alias("o")), lambda b: (b["n"] >= 1_200) & has("last_r") & (has("last_m") | has("last_d")) & b["o"] | (b["n"] >= 2_000) & (has("last_m").cast("int") + has("last_r").cast("int") + has("last_d").cast("int") >= 2))
    allowed = {"abstract_removed": F.col("id.removed"), "introduction": F.lit(True), "structure": F.lit(True), "sections": report}
    none = F.lit(None).cast("string")
    made = lambda text, stage, preview: F.struct(text.alias("text"), F.lit(stage).alias("stage"), preview.alias("preview"))
    long_enough = lambda stage: lambda t: F.when(F.length(t) >= LEAST, made(t, stage, none))
    tried = [let(F.when(F.col(s).isNotNull() & allowed[stage], stretch(stage, s)), long_enough(stage)) for stage, s in starts.items()]
    out = F.coalesce(*tried, made(none, "failed", truncate_words(stretch("abstract_removed", "p"), 4_000)))
    found = one.select(F.col("id.id").alias("id"), out.alias("out")).select("id", "out.*")
    missing = papers.where(F.col(text_col).isNull()).select(F.col(id_col).alias("id"), none.alias("text"), F.lit("failed").alias("stage"), none.alias("preview"))
    return found.unionByName(missing).withColumnRenamed("id", id_col)


def extraction_contexts(bodies: DataFrame, id_col: str = "source_id", text_col: str = "text", most: int = 45_000) -> DataFrame:
    """(id, text, strategy, sections, truncated): each body without abstract and references, or its sections by priority.

    Sections are taken as PRIORITY orders them while room is left, the last cut to what remains (two characters go for
    each), and stand in document order again.
    """
    rows = heading_index(bodies, id_col, text_col)
    spoken = F.regexp_replace("word", r"\s+", " ")
    lined = F.col("line").isNotNull()
    rows = rows.withColumn("spoken", spoken).withColumn("end", _least(lined & F.col("plain_line") & F.col("word").isin("references", "bibliography"), F.col("at") - F.col("line"))).withColumn("a", _least((F.col("word") == "abstract") & F.col("rest").rlike(r"^\s"), F.col("at")))
    rows = rows.withColumn("f", _least(F.col("spoken").isin(*FOLLOWS) & (F.col("at") > F.col("a")) & (F.col("end").isNull() | (F.col("at") < F.col("end"))), F.col("at")))
    inside = (F.col("f").isNull() | (F.col("at") < F.col("a")) | (F.col("at") >= F.col("f"))) & (F.col("end").isNull() | (F.col("at") < F.col("end")))
    rows = rows.withColumn("piece", F.when(F.col("end").isNotNull() & (F.col("at") < F.col("end")), F.substring("piece", F.lit(1), (F.col("end") - F.col("at")).cast("int"))).otherwise(F.col("piece"))).where(inside)
    # a heading takes its number and line along from the piece before it
    order = Window.partitionBy("id").orderBy("i")
    by_line = lined & F.col("spoken").isin(*SECTIONS)
    authors = F.col("authors") & F.col("piece").startswith("conclusions")
    inline = F.col("piece").rlike(INLINE) & (~F.col("piece").startswith("conclusions") | authors)
    rows = rows.withColumn("lines", F.max(by_line).over(_all())).withColumn("head", F.when(F.col("lines"), by_line).otherwise(inline))
    rows = rows.withColumn("taken", F.when(F.col("head") & F.col("lines"), F.col("line")).when(F.col("head") & authors, F.length(F.lit("Authors' "))).otherwise(0))
    before, given = F.coalesce(F.right(F.lag("piece").over(order), F.col("taken")), F.lit("")), F.coalesce(F.lead("taken").over(order), F.lit(0))
    rows = rows.select("id", "i", "head", "spoken", F.concat(before, F.substring("piece", F.lit(1), F.length("piece") - given)).alias("piece"), F.sum(F.col("head").cast("int")).over(order).alias("k"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "")
    sections = rows.groupBy("id", "k").agg(F.max(F.when(F.col("head"), F.col("spoken"))).alias("name"), joined.alias("text"))
    whole = sections.groupBy("id").agg(_strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "")).alias("whole"))
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("name"))
    named = sections.where("name IS NOT NULL").select("id", "k", "name", _strip(F.col("text")).alias("text"), rank.alias("rank"))
    used = F.sum(F.length("text") + 2).over(Window.partitionBy("id").orderBy("rank", "k").rowsBetween(Window.unboundedPreceding, -1))
    named = named.withColumn("left", F.lit(most) - F.coalesce(used, F.lit(0))).where("left > 0").withColumn("text", F.substring("text", F.lit(1), F.col("left").cast("int")))
    chosen = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "name", "text"))).alias("all"))
    out = lambda text, how, names: F.struct(text.alias("text"), F.lit(how).alias("strategy"), names.alias("sections"), (F.length(text) < F.length("whole")).alias("truncated"))
    some = F.when(F.col("all").isNotNull(), out(F.array_join(F.transform("all", lambda s: s["text"]), "\n\n"), "section_priority", F.transform("all", lambda s: s["name"])))
    made = F.when(F.length("whole") <= most, out(F.col("whole"), "complete_body_without_abstract_or_references", F.array(F.lit("complete_body")))).otherwise(F.coalesce(some, out(truncate_words(F.col("whole"), most), "body_prefix_fallback", F.array(F.lit("body_prefix")))))
    return whole.join(chosen, "id", "left").select(F.col("id").alias(id_col), made.alias("c")).select(id_col, "c.*")
