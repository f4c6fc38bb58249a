"""Inputs of the sequence queries, derived from the given tables; each grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifdrift import settings
from motifdrift.functions.columns import drawn
from motifdrift.operators.clean import apply_day_policy, drop_null_dates, parse_dates, split_description, valid_sequences
from motifdrift.operators.cluster import centroid_table
from motifdrift.operators.dataset import build_rows
from motifdrift.operators.link import link_clusters
from motifdrift.operators.ngrams import around_sites, distinct_trigrams, sequence_vectors
from motifdrift.operators.walks import numbered_members, with_member
from motifdrift.sources.scratch import written
from motifdrift.sources.tables import driver_table, site_table

WIDTH = 8
DIMS = [f"d{i}" for i in range(1, WIDTH + 1)]
STEPS = 3
#: Letters of a piece of a text, and the bits of a record_idx that number the pieces of a document.
PIECE, PIECE_BITS = 1273, 21
#: Records of a batch: all pieces of 250 documents.
BATCH = 250 << PIECE_BITS


def whole_div(a, b: int):
    return F.floor(a / b).cast("long")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it has fewer files; large tables have more, and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def once(df: DataFrame, name: str, value) -> DataFrame:
    """df with a derived column that is computed once for a row: filters on it can't be pushed below the generator, where each would compute it again."""
    return df.withColumn(name, F.explode(F.array(value)))


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id (made of the document's and the piece's number), source, s0: whole texts as successive pieces; a text without letters is one empty piece."""
    docs = once(docs, "_letters", F.upper(F.regexp_replace("text", "[^A-Za-z]+", "")))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_letters"), F.lit(1)), F.lit(PIECE))
    cut = docs.select("doc_id", "source", F.posexplode(F.transform(starts, lambda i: F.substring("_letters", i, F.lit(PIECE)))).alias("piece", "s0"))
    return cut.select((F.shiftleft(F.col("doc_id"), PIECE_BITS) + F.col("piece")).alias("doc_id"), "source", "s0")


def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_idx, description, sequence: FASTA-like records made from documents, one for each piece of a text."""
    docs = pieces(spread(driver_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))).withColumn("h", drawn(F.col("doc_id")))
    h = F.col("h")
    s0 = F.col("s0")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    description = F.concat(
        F.lit(">Spike|iso/"), "source", F.lit("/"), (h % 400).cast("string"), F.lit("|"), (2020 + h % 2).cast("string"), F.lit("-"),
        two(1 + whole_div(h, 2) % 12), F.lit("-"), two(whole_div(h, 24) % 32), F.lit("|EPI|x"),
    )
    letters = F.when(whole_div(h, 768) % 10 == 0, s0).otherwise(F.translate(s0, "BJZX", "ALGS"))
    sequence = F.concat(letters, F.when(whole_div(h, 7680) % 20 == 0, "").otherwise("*"))
    return once(docs.select(F.col("doc_id").alias("record_idx"), description.alias("description"), "s0", "h"), "sequence", sequence).drop("s0", "h")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_idx, isolate_name, timestamp (date), sequence of valid records."""
    return drop_null_dates(parse_dates(apply_day_policy(split_description(valid_sequences(isolates(spark, sf_dir))))))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_idx, period (quarter), period_idx, cluster, sequence; sequences share a beginning, so that walks can pass. Kept for the steps of a query that read it again."""
    rows = written(dated(spark, sf_dir), "dated")
    base = rows.agg(F.min_by("sequence", F.struct(-F.length("sequence"), "record_idx")).alias("b")).first().b
    quarter = F.quarter("timestamp")
    period_idx = ((F.year("timestamp") - 2020) * 4 + quarter).cast("int")
    rows = rows.select(
        "record_idx", F.concat(F.year("timestamp").cast("string"), F.lit("-q"), ((quarter - 1) * 3 + 1).cast("string")).alias("period"), period_idx.alias("period_idx"),
        (drawn("cl", F.col("record_idx")) % 3).cast("int").alias("cluster"), (drawn("cut", F.col("record_idx")) % 1260).cast("int").alias("cut"), "sequence",
    )
    short = (F.col("record_idx") % 3 == 0) | ((F.col("period_idx") == 3) & (F.col("cluster") == 2))
    own = F.when(short, F.concat(F.substring("sequence", F.lit(1), F.length("sequence") - 3), F.lit("*"))).otherwise(F.col("sequence"))
    mixed = F.concat(F.substring(F.lit(base), F.lit(1), F.col("cut")), F.substring(own, F.col("cut") + 1, F.lit(2000)))
    return once(rows, "_mixed", mixed).select("record_idx", "period", "period_idx", "cluster", F.col("_mixed").alias("sequence")).transform(lambda df: written(df, "members"))


def vocab(rows: DataFrame) -> DataFrame:
    """idx, words, d1..: distinct trigrams without *; at most 26 cubed, so one task numbers them."""
    from pyspark.sql.window import Window

    words = distinct_trigrams(rows).filter(~F.contains("words", F.lit("*")))
    value = lambda j: ((drawn(F.col("words"), j) % 2001 - 1000) / F.lit(1000.0)).cast("double")
    return words.select((F.row_number().over(Window.orderBy("words")) - 1).cast("int").alias("idx"), "words", *[value(j).alias(f"d{j}") for j in range(1, WIDTH + 1)])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, period_idx, cluster (the label), features of embeddings."""
    e = driver_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 6).cast("int").alias("period_idx"), F.col("label").cast("int").alias("cluster"), F.col("embedding").cast("array<double>").alias("features"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_table(points(spark, sf_dir), ["period_idx", "cluster"], 6)


def member_links(rows: DataFrame) -> DataFrame:
    """period_idx, cluster, next_cluster of members, by the mean vectors of their clusters."""
    vectors = sequence_vectors(rows, vocab(rows), DIMS).join(rows.select("record_idx", "period_idx", "cluster"), "record_idx")
    means = vectors.groupBy("period_idx", "cluster").agg(*[F.round(F.avg(d), 6).alias(d) for d in DIMS])
    return link_clusters(means.select("period_idx", "cluster", F.array(*DIMS).alias("features")))


def fixed_walks(rows: DataFrame) -> DataFrame:
    """sample_id, seqs (around_sites() of the sequences): for every member a walk along periods of one cluster."""
    numbered = numbered_members(rows.withColumn("sequence", around_sites(F.col("sequence"), settings.site_positions())))
    s = F.col("sample_id")
    steps = rows.select(F.col("record_idx").alias("sample_id")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    wanted = steps.select("sample_id", "t", (1 + s % 5 + F.col("t")).cast("int").alias("period_idx"), (s % 3).cast("int").alias("cluster"))
    met = with_member(wanted, numbered, s)
    listed = met.groupBy("sample_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("t", "sequence"))).alias("c"))
    return listed.filter(F.col("n") == STEPS + 1).select("sample_id", F.col("c.sequence").alias("seqs"))


def walk_rows(rows: DataFrame, take: tuple[str, ...] = ("y", "x"), words: DataFrame | None = None) -> DataFrame:
    """row_id, y, x of fixed_walks(); other columns as build_rows() makes them. words: the vocabulary, where it is there already."""
    built = build_rows(fixed_walks(rows), site_table(rows.sparkSession), vocab(rows) if words is None else words, take=take, cut=True)
    return built.select((F.col("sample_id") * len(settings.site_positions()) + F.col("ordinal")).alias("row_id"), *take)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, epoch, batch, scores, y of events."""
    e = F.col("event_id")
    draw = lambda name: ((drawn(name, e) % 4001 - 2000) / F.lit(1000.0)).cast("double")
    return driver_table(spark, sf_dir, "events").select(
        e.alias("row_id"), whole_div(e, 1000).alias("epoch"), whole_div(e % 1000, 64).alias("batch"), F.array(draw("s0"), draw("s1")).alias("scores"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y (quality), p (toxic) of labels."""
    return driver_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("p"))
