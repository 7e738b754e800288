"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted into cells (source, language, topic). The cells' token weights are raked in turn to the target
shares of sources, languages and topics: in each step a cell's weight is multiplied by target / current share of its
margin, a window sum over the margin. The raked weight times the sampling fraction is a document's inclusion
probability; where it would exceed 1, it is 1 and the rest stays as the document's repetition weight. ``sample``
does not repeat documents: there a cell's weight stops where its probability is 1 and the raking moves what is over
to the other cells of the margins; only a margin that has too few tokens in all stays below its target. A
document is sampled if a number in [0, 1) from the MD5 of its id and the seed lies below its probability, so
the sample does not depend on partitioning and repeats exactly.

Targets: a mapping value -> share for a margin, or a power (0: uniform, 1: as found) of the shares found. Values
that a mapping lacks keep the share they have relative to each other in what the mapping leaves over.

Very long texts count with all their tokens; equal draws of equal ids are alike; rows without an id are drawn by text,
source and language in ``sample``.

Cases: null source or language is the value '(none)'; a null or empty text has no tokens, its cell is raked by the
other documents' tokens and it gets their probability, or 1 if it has none to lean on; repeated rows are each
sampled alike; an empty table gives no rows; columns other than the named ones are passed through by ``sample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

MARGINS = ("source", "lang", "topic")
#: Powers of the found shares that the targets take, steps through all margins, share of tokens to sample, seed.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ROUNDS, FRACTION, SEED = 10, 0.5, "7"
#: Cells that may be broadcast.
CELLS = 100_000

#: The words of the topic rules (fixed values): a text's topic is the first whose marker it holds.
TOPICS = [("legal", "icense"), ("table", " | "), ("symbols", "###"), ("shouting", "!! "), ("records", "@")]
LONG = 4000


def topic_of(text: Column) -> Column:
    out = F.when(text.isNull() | (text == ""), "empty")
    for name, mark in TOPICS:
        out = out.when(text.contains(mark), name)
    return out.when(F.length(text) > LONG, "long").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """White-space separated tokens."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long")


def _one_task(cells: DataFrame) -> DataFrame:
    """A small cell table in one partition, so that its windows need no exchange; a larger one as it is."""
    return cells.coalesce(1) if cells.count() <= CELLS else cells


def _target(cells: DataFrame, margin: str, target) -> DataFrame:
    """(margin, share): shares over the values found, summing to 1."""
    found = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t"))
    if isinstance(target, dict):
        named = F.coalesce(*[F.when(F.col(margin) == k, F.lit(float(v))) for k, v in target.items()], F.lit(None).cast("double")) if target else F.lit(None).cast("double")
        total = found.withColumn("named", named).agg(F.sum("named").alias("n"), F.sum(F.when(F.col("named").isNull(), F.col("t"))).alias("r"))
        joined = found.withColumn("named", named).crossJoin(F.broadcast(total))
        left = F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce("n", F.lit(0.0)))
        raw = joined.select(margin, F.coalesce("named", left * F.col("t") / F.col("r")).alias("s"))
    else:
        raw = found.select(margin, F.when(F.col("t") > 0, F.pow("t", F.lit(float(target)))).otherwise(0.0).alias("s"))
    whole = raw.agg(F.sum("s").alias("whole"))  # one row
    return raw.crossJoin(F.broadcast(whole)).select(margin, F.when(F.col("whole") > 0, F.col("s") / F.col("whole")).otherwise(0.0).alias("share"))


def raked(cells: DataFrame, targets=None, rounds: int = ROUNDS, most: float | None = None) -> DataFrame:
    """The cells (source, lang, topic, tokens) with a column weight, ``most`` at most, whose token-weighted margins meet the targets."""
    targets = TARGETS | (targets or {})
    out = cells.withColumn("weight", F.lit(1.0))
    for m in MARGINS:
        out = out.join(_target(cells, m, targets[m]).withColumnRenamed("share", f"to_{m}"), m)
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))
    out = _one_task(cut(out.crossJoin(F.broadcast(total))))
    for k in range(rounds):
        for m in MARGINS:
            now = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(m))
            out = out.withColumn("now", now).withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.col(f"to_{m}") * F.col("total") / F.col("now")).otherwise(F.col("weight"))).drop("now")
            if most is not None:
                out = out.withColumn("weight", F.least("weight", F.lit(float(most))))
        if k % 5 == 4:
            out = _one_task(cut(out))
    return out.drop("total")


def margin_errors(fitted: DataFrame) -> DataFrame:
    """(margin, value, share, target, error) of raked cells: how far each margin's token share is from its target."""
    out = None
    for m in MARGINS:
        now = fitted.groupBy(F.col(m).alias("value")).agg(F.sum(F.col("weight") * F.col("tokens")).alias("t"), F.first(f"to_{m}").alias("target"))
        all_ = fitted.agg(F.sum(F.col("weight") * F.col("tokens")).alias("all"))
        one = now.crossJoin(F.broadcast(all_)).select(F.lit(m).alias("margin"), "value", (F.col("t") / F.col("all")).alias("share"), "target")  # the right side is one row
        out = one if out is None else out.unionByName(one)
    return out.withColumn("error", F.abs(F.col("share") - F.col("target")))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """The documents' cells. ``topic`` is a column with given or learned topics; without one the marker rules decide."""
    text = F.col(text_col).cast("string")
    topic = topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit("(none)"))
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("(none)")).alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit("(none)")).alias("lang"), topic.alias("topic"), tokens_of(text).alias("tokens")
    )


def probabilities(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang", targets=None, fraction: float = FRACTION, seed: str = SEED, rounds: int = ROUNDS, topic: Column | None = None) -> DataFrame:
    """One row for each document: id, source, lang, topic, tokens, weight, p, repeat and sampled. A null id is drawn as the text ''."""
    rows = cut(described(docs, id_col, text_col, source_col, lang_col, topic))
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    fitted = cut(raked(cells, targets, rounds).select(*MARGINS, "weight"))
    fitted = F.broadcast(fitted) if fitted.count() <= CELLS else fitted
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    wanted = F.col("weight") * fraction
    return (
        rows.join(fitted, list(MARGINS), "left")
        .withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        .withColumn("p", F.least(F.lit(1.0), wanted))
        .withColumn("repeat", F.when(F.col("p") > 0, wanted / F.col("p")).otherwise(0.0))
        .withColumn("sampled", u < F.col("p"))
        .withColumnRenamed("id", id_col)
    )


def sample(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang", targets=None, fraction: float = FRACTION, seed: str = SEED, rounds: int = 2 * ROUNDS) -> DataFrame:
    """The sampled documents, with their own columns; rows without an id are drawn by their text, source and language."""
    text, none = F.col("text").cast("string"), F.lit("(none)")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"))
    drawn = F.coalesce("id", F.concat_ws("|", F.lit(""), F.md5(F.coalesce(text, F.lit(""))), "source", "lang"))
    rows = rows.select("own", drawn.alias("id"), F.coalesce("source", none).alias("source"), F.coalesce("lang", none).alias("lang"), topic_of(text).alias("topic"))
    cells = cut(described(docs, id_col, text_col, source_col, lang_col).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    fitted = cut(raked(cells, targets, rounds, 1 / fraction if fraction > 0 else None).select(*MARGINS, "weight"))
    fitted = F.broadcast(fitted) if fitted.count() <= CELLS else fitted
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("id"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return rows.join(fitted, list(MARGINS), "left").where(u < F.coalesce("weight", F.lit(1.0)) * fraction).select("own.*")
