"""Lookups, overlays and containment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import collapse, dehyphenate, expand_ligatures

#: Rows and bytes of a table that may be broadcast after they were counted.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows and ``size`` bytes; else as it is, for a shuffled join. One job over ``most`` rows."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    text = lambda c: F.octet_length(f"`{c}`" if kinds[c] in ("string", "varchar", "char", "binary") else F.to_json(F.struct(f"`{c}`")))
    plain = ("byte", "short", "integer", "long", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz", "decimal")
    held = sum((F.lit(16) if kinds[c] in plain else F.coalesce(text(c), F.lit(0)) for c in df.columns), F.lit(16))
    n, total = df.limit(most + 1).agg(F.count("*"), F.sum(held)).first()
    return F.broadcast(df) if n <= most and (total or 0) <= size else df


def candidate_lookup(df: DataFrame, key: str, candidates: Column, index: DataFrame, on: str, value: str) -> DataFrame:
    """For each row the value of the first of its candidates that the index has, and that candidate's place."""
    tried = df.select(key, F.posexplode(candidates).alias("pos", on))
    found = tried.join(small(index.select(on, value)), on)
    return found.groupBy(key).agg(F.min_by(value, "pos").alias(value), F.min("pos").alias("pos"))


def coverage_index(rows: DataFrame, names: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, place, fields): for each name in a JSON list column the first row that lists it, by ``order``, then place in the list.

    Cells are read leniently: null, broken and other JSON cells list nothing, numbers and truth values count as their text.
    Names are folded (case, white space); blank ones do not count. Postings are reduced before the shuffle, so a name that
    very many rows list costs one row a task.
    """
    from ..functions.text import name_key

    listed = rows.select(*order, *(f for f in fields if f not in order), F.posexplode(F.from_json(names, "array<string>")).alias("place", "_name"))
    keyed = listed.withColumn("key", name_key(F.col("_name"))).where("key <> ''")
    best = keyed.groupBy("key").agg(F.min_by(F.struct("place", *fields), F.struct(*order, "place")).alias("_row"))
    return best.select("key", "_row.*")


def compared(expected: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides by key: keys, ``side`` (both, missing, extra), ``n_answers``; a null key equals a null key."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    a, b = count(expected, "_e"), count(answers.select(*(F.col(k).alias(f"_{k}") for k in keys)).toDF(*keys), "n_answers").toDF(*(f"_{k}" for k in keys), "n_answers")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    side = F.when(F.col("n_answers").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("both")
    joined = a.join(b, same, "full_outer")
    return joined.select(*(F.when(F.col("_e").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys), side.alias("side"), F.coalesce("n_answers", F.lit(0)).alias("n_answers"))


def completed(expected: DataFrame, answers: DataFrame, keys: list[str], values: list[str], order: list[str], fallback: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Each expected row with its answer, and the keys that do not match (keys, side, n_answers).

    Without ``fallback`` the join is strict: missing or extra keys raise ``incomplete_answers`` with the first few. With it,
    missing answers take the fallback's columns and ``is_fallback``; extra answers are left out. The first of several answers
    by ``order`` counts.
    """
    report = compared(expected, answers, keys).where("side <> 'both'")
    if fallback is None:
        bad = [f"{r['side']}:{'|'.join(str(r[k]) for k in keys)}" for r in report.orderBy("side", *keys).limit(5).collect()]
        if bad:
            raise ValueError(f"incomplete_answers:{','.join(bad)}")
        fallback = {}
    first = answers.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    none = F.col("_v").isNull()
    out = expected.join(first, same, "left")
    return out.select(*expected.columns, *(F.when(none, fallback.get(v, F.lit(None))).otherwise(F.col(f"_v.{v}")).alias(v) for v in values), none.alias("is_fallback")), report


def nest_matches(probe: DataFrame, build: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each probe row with the array of its matches in order, and their number. A key's matches are one cell: they must fit a row."""
    nested = build.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("matches"))
    return probe.join(nested, key, "left").withColumn("match_count", F.coalesce(F.size("matches"), F.lit(0)))


def overlay(base: DataFrame, key: str, others: list[DataFrame], columns: list[str]) -> DataFrame:
    """For each column the first value that is not blank among the others, in order, then the base."""
    out = base
    for i, o in enumerate(others):
        out = out.join(o.select(F.col(key), *(F.col(c).alias(f"_{i}_{c}") for c in columns)), key, "left")
    merged = [F.coalesce(*(F.nullif(F.col(f"_{i}_{c}"), F.lit("")) for i in range(len(others))), F.col(c)).alias(c) for c in columns]
    return out.select(key, *merged)


def tier3(c: Column) -> Column:
    return collapse(dehyphenate(expand_ligatures(c)))


_TRIGRAM = r"(?s)(?=(.{3}))"


def grounded(quotes: DataFrame, bodies: DataFrame, quote_id: str, quote: str, body_id: str, body: str) -> DataFrame:
    """(body id, quote id, tier): quotes that a body holds exactly, after white space, or after ligatures and hyphens.

    Each tier's match is also a match of the normalised texts, whose inner words then agree. So quotes of three words and
    more are joined by their longest inner word to the distinct words of the bodies, shorter ones by one of their
    trigrams to the distinct trigrams; no text is compared with all quotes. Only what has under three characters meets all
    bodies, in blocks of BROADCAST_ROWS. Pairs stay rows: a body that very many quotes share a word with is no large cell.
    """
    # never null, so that Spark adds no null test that normalises every text once more
    plain = lambda c: F.coalesce(tier3(F.col(c)), F.lit(""))
    q = quotes.select(F.col(quote_id).alias("qid"), F.col(quote).alias("q")).where("q is not null and trim(q) <> ''").withColumn("qn", plain("q")).withColumn("qw", F.split("qn", " "))
    raw = bodies.select(F.col(body_id).alias("bid"), F.col(body).alias("b")).where("b is not null")
    longest = F.array_max(F.transform(F.slice("qw", F.lit(2), F.size("qw") - 2), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    long, brief = F.size("qw") >= 3, F.length("qn") >= 3
    of = lambda text: F.regexp_extract_all(text, F.lit(_TRIGRAM), F.lit(1))
    spread = F.array_max(F.transform(of(F.col("qn")), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]
    n = q.agg(F.count_if(long), F.count_if(~long & brief), F.count_if(~long & ~brief)).first()
    both = raw.limit(0).select("bid", F.lit(None).cast(q.schema["qid"].dataType).alias("qid"), F.col("b").alias("q"), "b")
    for have, some, gram, parts in ((n[0], q.where(long), longest, lambda: F.split(plain("b"), " ")), (n[1], q.where(~long & brief), spread, lambda: of(plain("b")))):
        if not have:
            continue
        keyed = some.withColumn("gram", gram)
        grams = raw.select("bid", F.explode(F.array_distinct(parts())).alias("gram"))
        pairs = grams.join(small(keyed.select("gram", "qid")), "gram").select("bid", "qid").distinct()
        found = raw.join(pairs, "bid").join(small(some.select("qid", "q", "qn")), "qid").where(F.contains(plain("b"), F.col("qn"))).select("bid", "qid", "q", "b")
        both = both.unionByName(found)
    tiny = q.where(~long & ~brief)
    blocks = -(-n[2] // BROADCAST_ROWS)
    for i in range(blocks):
        block = F.broadcast(tiny.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i))  # of under three characters each
        both = both.unionByName(raw.withColumn("bn", plain("b")).join(block, F.col("bn").contains(F.col("qn"))).select("bid", "qid", "q", "b"))
    tier = F.when(F.col("b").contains(F.col("q")), "exact").when(collapse(F.col("b")).contains(collapse(F.col("q"))), "whitespace").otherwise("normalized")
    return both.select(F.col("bid").alias(body_id), F.col("qid").alias(quote_id), tier.alias("tier"))


def closure(pairs: DataFrame, alias: str = "alias", target: str = "target") -> DataFrame:
    """(alias, root, steps, status) of a table of aliases: the end of each chain, by doubling the pointers.

    Each round looks up the rows that have not arrived at where they point to and goes on from there, so that a chain of n
    steps takes log2 n rounds. A chain that ends has a row at each distance from its end, so that each round lets rows
    arrive until all have: what is left when none arrives goes in a circle or runs into one: status ``cycle``, root and steps null. An alias with several targets takes the smallest and is
    ``ambiguous``; others are ``resolved``. Null and blank aliases and targets are no aliases; one that points to itself is a
    circle.
    """
    rows = pairs.select(F.col(alias).alias("alias"), F.col(target).alias("to")).where("coalesce(trim(alias), '') <> '' AND coalesce(trim(to), '') <> ''")
    rows = rows.groupBy("alias").agg(F.min("to").alias("to"), (F.min("to") != F.max("to")).alias("several"))
    known = rows.select(F.col("alias").alias("k"))
    # ``done``: nothing stands for the target
    rows = rows.join(known, F.col("to") == F.col("k"), "left").select("alias", "to", F.lit(1).cast("long").alias("steps"), F.col("k").isNull().alias("done"), "several")
    rows = _saved(rows)
    ready = []
    while True:
        ready.append(rows.where("done"))
        open_ = rows.where("not done")
        if not ready[-1].limit(1).count() or not open_.limit(1).count():
            break
        # a row that has arrived is looked up as well: all rows so far, arrived in any round
        every = ready[0]
        for r in ready[1:]:
            every = every.unionByName(r)
        ahead = every.unionByName(open_).select(F.col("alias").alias("at"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("done").alias("arrived"))
        rows = _saved(open_.join(ahead, F.col("to") == F.col("at")).select("alias", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("arrived").alias("done"), "several"))
    status = F.when(F.col("several"), "ambiguous").otherwise("resolved")
    out = None
    for r in ready:
        one = r.select(F.col("alias").alias(alias), F.col("to").alias("root"), "steps", status.alias("status"))
        out = one if out is None else out.unionByName(one)
    circle = rows.where("not done").select(F.col("alias").alias(alias), F.lit(None).cast(rows.schema["to"].dataType).alias("root"), F.lit(None).cast("long").alias("steps"), F.lit("cycle").alias("status"))
    return out.unionByName(circle)


def _saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a loop's plan stays short."""
    from ..streaming.events import work_folder

    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rule_table(c: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule (pattern, label) that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def renamed(df: DataFrame, slug: str, taken: DataFrame, order: str) -> DataFrame:
    """New slugs for rows whose slug is taken: the first free of _generated, _generated_2, ... without an end."""
    names = taken.select(F.col(slug).alias("_t")).distinct()
    hit = df.join(names, F.col(slug) == F.col("_t"), "left_semi").groupBy(slug).agg(F.min(order).alias("_o")).select(slug)
    form = r"(?s)^(.*)_generated(?:_([1-9][0-9]{0,17}))?\z"
    number = F.regexp_extract("_t", form, 2)
    used = names.where(F.col("_t").rlike(form)).select(F.regexp_extract("_t", form, 1).alias("_base"), F.when(number == "", 1).otherwise(F.try_to_number(number, F.lit("9" * 18))).cast("long").alias("_n"), (number == "1").alias("_odd"))
    used = used.where("not _odd").join(hit.select(F.col(slug).alias("_base")), "_base", "left_semi")
    run = used.withColumn("_k", F.row_number().over(Window.partitionBy("_base").orderBy("_n"))).groupBy("_base").agg(F.count_if(F.col("_n") == F.col("_k")).alias("_full"))
    first = F.coalesce("_full", F.lit(0)) + 1
    name = F.concat(F.col(slug), F.lit("_generated"), F.when(first > 1, F.concat(F.lit("_"), first.cast("string"))).otherwise(""))
    return hit.join(run, F.col(slug) == F.col("_base"), "left").select(slug, name.alias("new_slug"))
