"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. The whole part is taken as it
is; the fractional parts are rounded in pairs: of two documents one gains and the other loses the same number of words, by
chance and without bias, until one of them is a whole copy or none. A group of about `fan` documents thus ends with one
fractional document; these meet in groups again, level by level. Pairs are of like size (a power of two apart at most), so
that a source ends with one fractional document for each size class; these few are rounded from the largest down, each so
as to lessen the error so far. The words taken from a source thus miss its target by about a small document's size.

Groups are formed by a hash, `fan` documents on average, whatever the size of the source: a source with a third of all
rows has as many more groups. Chance comes from hashes of the documents, so that reruns agree. Equal rows are one item with
a multiplicity: all their copies but a fraction are whole, the fraction is rounded as one document's, and the copies are
dealt to the rows as evenly as can be; so equal rows, however many, never meet in one group.

Cases: null, empty and white-space texts have size 0 and no words are taken of them; a null source is one source, ordered
last; an empty table gives an empty result; a null doc_id is carried along.
Extra columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IDENTITY, identity, row_key, saved


def word_count(text: Column) -> Column:
    """Number of runs outside 0x20 and 0x09-0x0D; 0 for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def ranked(groups: DataFrame, key: str) -> DataFrame:
    """Adds `rank`, the place (from 0) in the order of key, nulls last, without sorting all rows in one task."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).isNull(), F.col(key)]
    cut = saved(groups.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = {r["_part"]: r["count"] for r in cut.groupBy("_part").count().collect()}  # a row for each partition
    before, at = [], 0
    for part in sorted(sizes):
        before.append((part, at))
        at += sizes[part]
    offset = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(p), F.lit(a)) for p, a in before])), F.col("_part")) if before else F.lit(0)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return cut.withColumn("rank", place + offset).drop("_part")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sources (source, source_size) -> with target: weights repeat over the sources in code point order, null last."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = saved(ranked(sources, "source").withColumn("weight", w).drop("rank"), "sources")
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while total > 0:  # the level only rises, and each round fills up at least one more source
        now = F.lit(level) * F.col("weight") >= most * F.col("source_size")
        open_, taken, n = s.agg(F.sum(F.when(~now, F.col("weight"))), F.sum(F.when(now, most * F.col("source_size"))), F.count(F.when(now, 1))).first()
        if not open_ or n == full:
            break
        full, level = n, (total - (taken or 0)) / open_
    return s.withColumn("target", F.least(F.lit(level) * F.col("weight"), most * F.col("source_size").cast("double")) if total else F.lit(0.0))


def _chance(level: int) -> str:
    return f"(pmod(xxhash64(acc.key, d.key, {level}), 9007199254740992) / 9007199254740992D)"


def _round(groups: DataFrame, level: int) -> DataFrame:
    """One level: items (key, doc_id, size, m, x) of a group folded into finished ones and one left over."""
    item = "struct<key:bigint,doc_id:bigint,size:bigint,m:bigint,x:double>"
    start = f"named_struct('done', cast(array() as array<{item}>), 'key', cast(null as bigint), 'doc_id', cast(null as bigint), 'size', cast(null as bigint), 'm', cast(null as bigint), 'x', cast(null as double))"
    # up: the words that the left-over can gain from d; down: those that it can lose to d
    up, down = "least((1 - acc.x) * acc.size, d.x * d.size)", "least(acc.x * acc.size, (1 - d.x) * d.size)"
    gains = f"{_chance(level)} * ({up} + {down}) < {down}"
    own = lambda x: f"named_struct('key', acc.key, 'doc_id', acc.doc_id, 'size', acc.size, 'm', acc.m, 'x', {x})"
    new = lambda x: f"named_struct('key', d.key, 'doc_id', d.doc_id, 'size', d.size, 'm', d.m, 'x', {x})"
    left = lambda done, who, x: f"named_struct('done', array_append(acc.done, {done}), 'key', {who}.key, 'doc_id', {who}.doc_id, 'size', {who}.size, 'm', {who}.m, 'x', {x})"
    step = f"""case when acc.key is null then named_struct('done', acc.done, 'key', d.key, 'doc_id', d.doc_id, 'size', d.size, 'm', d.m, 'x', d.x)
        when {gains} then case when (1 - acc.x) * acc.size <= d.x * d.size then {left(own("1D"), "d", f"d.x - {up} / d.size")} else {left(new("0D"), "acc", f"acc.x + {up} / acc.size")} end
        else case when acc.x * acc.size <= (1 - d.x) * d.size then {left(own("0D"), "d", f"d.x + {down} / d.size")} else {left(new("1D"), "acc", f"acc.x - {down} / acc.size")} end end"""
    return groups.select("source", "cls", "n", F.expr(f"aggregate(items, {start}, (acc, d) -> {step})").alias("r"))


def _settle(left: DataFrame) -> DataFrame:
    """The last few of a source, one for each size class: from the largest down, each rounded to lessen the error so far."""
    items = left.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "key", "doc_id", "m", "x")), asc=False).alias("items"))
    item = "struct<key:bigint,doc_id:bigint,size:bigint,m:bigint,x:double>"
    put = lambda x: f"array_append(acc.done, named_struct('key', d.key, 'doc_id', d.doc_id, 'size', d.size, 'm', d.m, 'x', {x}))"
    more, less = "acc.err + (1 - d.x) * d.size", "acc.err - d.x * d.size"
    step = f"case when abs({more}) < abs({less}) then named_struct('done', {put('1D')}, 'err', {more}) else named_struct('done', {put('0D')}, 'err', {less}) end"
    folded = items.select("source", F.expr(f"aggregate(items, named_struct('done', cast(array() as array<{item}>), 'err', 0D), (acc, d) -> {step})").alias("r"))
    return folded.select("source", F.explode("r.done").alias("d")).select("source", "d.*")


def copies(sized: DataFrame, sources: DataFrame, fan: int) -> DataFrame:
    """sized (key, doc_id, source, size, m), sources (source, source_size, target) -> with source_size, target, and copies of all m."""
    s = sources.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    all_ = sized.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("x", F.col("m") * rate - F.floor(F.col("m") * rate))
    fractional = (F.col("x") > 0) & (F.col("size") > 0)
    live = all_.where(fractional).select("source", "key", "doc_id", "size", "m", "x", F.floor(F.log2("size")).alias("cls"))
    counts = saved(live.groupBy("source", "cls").agg(F.count("*").alias("n")), "classes")
    most = counts.agg(F.max("n")).first()[0] or 0
    counts = counts.withColumnsRenamed({"source": "_source", "cls": "_cls"})
    live = live.join(counts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cls") == F.col("_cls"))).drop("_source", "_cls")
    rounded = all_.where(~fractional).select("source", "key", "doc_id", "size", "m", F.lit(0.0).alias("x"))
    level = 0
    while most > 1:  # ends with one item for each source and class
        groups = live.withColumn("group", F.pmod(F.xxhash64("key", F.lit(level)), F.ceil(F.col("n") / fan ** (level + 1))))
        groups = groups.groupBy("source", "cls", "n", "group").agg(F.sort_array(F.collect_list(F.struct("key", "doc_id", "size", "m", "x"))).alias("items"))
        out = saved(_round(groups, level), "pivot")
        rounded = rounded.unionByName(out.select("source", F.explode("r.done").alias("d")).select("source", "d.*"))
        live = out.select("source", "r.key", "r.doc_id", "r.size", "r.m", "r.x", "cls", "n")
        level += 1
        if most <= fan**level:
            break
    rounded = rounded.unionByName(_settle(live))
    whole = s.select("_source", "source_size", "target", rate.alias("rate"))
    out = rounded.join(whole, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return out.withColumn("copies", (F.floor(F.col("m") * F.col("rate")) + F.col("x")).cast("long")).drop("rate")


def _dealt(items: DataFrame, most: int = 10_000) -> DataFrame:
    """items with the copies of all their m equal rows -> a row for each of the m with its own; very many in parts."""
    one = items.where("m = 1").drop("m", "x")
    many = items.where("m > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / most))))
    many = many.repartition("key", "part").withColumn("row", F.explode(F.sequence(F.col("part") * most, F.least((F.col("part") + 1) * most, F.col("m")) - 1)))
    many = many.withColumn("copies", F.floor(F.col("copies") / F.col("m")) + (F.col("row") < F.col("copies") % F.col("m")).cast("long"))
    return one.unionByName(many.select(*one.columns))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, fan: int = 128) -> DataFrame:
    """documents (doc_id, text, source) -> key, doc_id, source, size, source_size, target, copies, taken, a row for each.

    The sources share `share` times all words by weight, none above `most` times its own; the excess goes to the others
    by weight. key is a hash of (doc_id, text): rows with equal ones are equal rows.
    """
    sized = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = saved(sized, "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = saved(targets(sources, weights, share, most), "targets")
    equal = sized.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("m"))
    out = _dealt(saved(copies(equal, sources, fan), "copies"))
    return out.select("key", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: each as many times as it has copies, with all columns."""
    got = mix(docs, **options).groupBy(*identity(F.col("key"), F.col("doc_id"))).agg(F.sum("copies").alias("copies")).where("copies > 0")
    once = docs.select(*identity(row_key(), F.col("doc_id").cast("long")), F.struct(*docs.columns).alias("row")).dropDuplicates(IDENTITY)
    # very many copies of one row come in parts
    part = once.join(got, IDENTITY).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 10_000))))
    return part.select("row", F.explode(F.sequence(F.col("part") * 10_000, F.least((F.col("part") + 1) * 10_000, F.col("copies")) - 1))).select("row.*")
