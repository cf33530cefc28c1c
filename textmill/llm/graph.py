"""Distributed connected components, written tables and the routing of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.session import scratch_path


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read back:
    a lost executor re-reads it instead of running everything before it again."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b: long); root is the smallest
    node of its component.  Alternates the large-star and the small-star step, each a
    partial minimum per node and a join back, until no edge changes; the edges of a
    round are a written table.  Empty links give no rows."""
    edges = stored(spark, links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                   .filter("u < v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")) \
            .filter("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        new = small.select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v") \
            .unionByName(low.select("v", F.col("m").alias("u"))).distinct()
        new = stored(spark, new, "edges")
        same = edges.agg(F.count("*"), F.sum(F.hash("v", "u").cast("long"))).first()
        edges, old = new, same
        if edges.agg(F.count("*"), F.sum(F.hash("v", "u").cast("long"))).first() == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")) \
        .unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def cells(df: DataFrame, keys: list[str], member: str, block: int, root: str | None = None) -> DataFrame:
    """Deals the members of each group into blocks of about ``block`` rows and every pair of
    blocks into a cell of its own, so that any two members meet in some cell and no task
    needs more than two blocks.  Adds ``cell`` and ``home`` (the member's block); groups of
    one member vanish.  A group of n rows makes n * n / block rows, never n * n.

    With ``root``, only members of different roots need to meet: those of a group's largest
    root have blocks of their own, which meet the others but not each other, so m others
    among n make m * n / block rows, and a group of one root vanishes."""
    if root is None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
        sizes = sizes.select(*keys, F.lit(0).alias("_main"), F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
        df = df.join(sizes, keys)
        first, count = F.lit(0), F.col("_blocks")
        others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    else:
        per = df.groupBy(*keys, root).agg(F.count("*").alias("_n"))
        sizes = per.groupBy(*keys).agg(F.max(F.struct("_n", root)).alias("_m"), F.sum("_n").alias("_n"))
        rest = F.col("_n") - F.col("_m._n")
        sizes = sizes.filter(rest > 0).select(
            *keys, F.col(f"_m.{root}").alias("_top"), F.ceil(F.col("_m._n") / block).cast("int").alias("_main"),
            (F.ceil(F.col("_m._n") / block) + F.ceil(rest / block)).cast("int").alias("_blocks"))
        df = df.join(sizes, keys)
        top = F.col(root) == F.col("_top")
        first = F.when(top, 0).otherwise(F.col("_main"))
        count = F.when(top, F.col("_main")).otherwise(F.col("_blocks") - F.col("_main"))
        others = F.when(top, F.sequence(F.col("_main"), F.col("_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    df = df.withColumn("home", (first + F.pmod(F.xxhash64(member), count)).cast("int"))
    df = df.withColumn("_other", F.explode(others))
    return df.withColumn("cell", F.least("home", "_other").cast("long") * F.col("_blocks")
                         + F.greatest("home", "_other")).drop("_blocks", "_other", "_main", "_top")


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and in ``count`` how many rows of ``left``
    it has.  Keys that a thousandth of all rows or more share are at most a thousand and
    joined by broadcast, so that the rest meets in a shuffle without a hot key."""
    total = right.agg(F.sum(count)).first()[0] or 0
    rows = right.select(key, F.struct(*[c for c in right.columns if c != key]).alias("_r"))
    common = F.col(f"_r.{count}") * 1000 >= total
    held = left.join(F.broadcast(rows.filter(common).withColumnRenamed("_r", "_hot")), key, "left")
    # rows that are served look under a key that is not there, each row of its own
    held = held.withColumn("_at", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(1 << 30))))
    held = held.join(rows.filter(~common).withColumn("_at", F.lit(0).cast("long")), [key, "_at"], "left")
    found = held.withColumn("_r", F.coalesce("_hot", "_r")).filter("_r is not null")
    return found.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in right.columns if c != key])


#: Bits of a key in the bitmaps that are broadcast, and of all of them at most: 64 MB at 32 bits a long.
KEY_BITS, MOST_BITS = 16, 1 << 28


def marked(rows: DataFrame, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """``rows`` and ``mark``: true where ``key``, a hash, is one of ``keys`` (each once), and at few others, so that a join
    with ``keys`` need not shuffle the rows where it is false.  The bits of the keys lie in bitmaps of 32,768;
    more keys than these have room for make more marks, and lose none."""
    size = 1 << min(max(keys.count() * KEY_BITS - 1, (1 << 15) - 1).bit_length(), MOST_BITS.bit_length() - 1)
    at = F.pmod(F.col(key), F.lit(size)) + 1
    bits = keys.select(F.bitmap_bucket_number(at).alias("_block"), F.bitmap_bit_position(at).alias("_place")) \
        .repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    # four bytes to a number, of which a row's is read in its place; binaries are copied whole to be read
    bits = bits.select("_block", F.expr("transform(sequence(0, 1023), i -> cast(conv(hex(substring(_bits, 4 * i + 1, 4)), 16, 10) as long))")
                       .alias("_bits"))
    place = F.bitmap_bit_position(at)
    shift = 24 - 8 * (F.floor(place / 8) % 4) + place % 8
    found = F.getbit(F.get("_bits", F.floor(place / 32).cast("int")), shift.cast("int")) == 1
    return rows.withColumn("_block", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "_block", "left") \
        .select(*rows.columns, F.coalesce(found, F.lit(False)).alias(mark))


def least_hashes(rows: DataFrame, limit: int, hash_col: str) -> DataFrame:
    """The rows that can be among the ``limit`` of least ``hash_col`` (uniform over all longs), and few
    others: those below a bound that follows from the number of rows, so that no task passes on
    more than its share.  Where equal hashes leave too few below it, all rows."""
    n = rows.count()
    if n <= 2 * limit:
        return rows
    bound = int((limit + 8 * limit**0.5 + 64) / n * 2**64) - 2**63
    some = rows.filter(F.col(hash_col) < F.lit(min(bound, 2**63 - 1)))
    return some if some.count() >= limit else rows
