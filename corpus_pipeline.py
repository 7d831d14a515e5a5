"""From raw documents to packed training sequences: five stages, each over all its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolake.llm import minhash, mixing, packing, surrogates, toxicity
from cartolake.llm.common import WORD, materialize, read, small_side, text_class
from cartolake.llm.queries import tokenizer
from cartolake.session import checkpoint_dir

# Fixed value: near copies share this part of their word shingles; op8_near_documents has a contract of its own (85).
NEAR_PERCENT = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on the labelled ones does not call toxic.

    A null text is judged like an empty one; repeated rows go or stay together; no
    rows give no rows.  All columns pass through, whatever their names.
    """
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_of(F.col("text"), model) < toxicity.THRESHOLD)


def one_of_each(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` with one row of those that agree in ``keys`` (null equals null); only repeated ones are shuffled."""
    own = [F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]
    again = materialize(docs.select(*own).groupBy(*(f"__{i}" for i in range(len(keys)))).agg(
        F.count("*").alias("__n")).filter("__n > 1"), "again")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    marked = docs.join(small_side(again, F.lit(64)), same, "left")
    first = Window.partitionBy(*keys).orderBy(*(c for c in docs.columns if c not in keys))
    several = marked.filter("__n is not null").withColumn("__r", F.row_number().over(first)).filter("__r = 1")
    return marked.filter("__n is null").select(*docs.columns).unionByName(several.select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows without id stay.

    Of one id's different texts each is judged by itself; rows that agree in id and text are one.
    """
    rows = minhash.near_documents(docs, percent=NEAR_PERCENT, identity=True).filter("first and doc_id is not null")
    # Texts with the same words are copies of each other; texts without words are not.
    same = F.when(F.col("n_shingles") > 0, F.col("cls")).otherwise(F.col("own"))
    kept = materialize(rows.groupBy(F.col("doc_id").alias("__id"), same.alias("__same")).agg(F.min("own").alias("__kept")).drop(
        "__same"), "kept")
    named = docs.filter("doc_id is not null").withColumn("__own", text_class(F.col("text")))
    left = named.join(small_side(kept, F.lit(48)), (F.col("doc_id") == F.col("__id")) & (F.col("__own") == F.col("__kept")), "left_semi")
    return one_of_each(left, ["doc_id", "__own"]).drop("__own").unionByName(docs.filter("doc_id is null"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the text.

    Null and empty texts stay (a null text has no n_chars), repeated rows stay repeated, no
    rows give no rows.  Other columns pass through, whatever their names.
    """
    named = docs.withColumnRenamed("n_entities", "__n_entities") if "n_entities" in docs.columns else docs
    done = surrogates.pseudonymise(named).drop("n_entities").withColumnRenamed("__n_entities", "n_entities")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is left out, taken, or taken twice; one at a quota's end is cut after a word.

    Null and empty texts have no words and are left out; a null source is one of its own;
    equal rows share what is taken of them; no rows give no rows.
    """
    pieces = mixing.mix(docs)[1]
    taken = materialize(pieces.groupBy("doc_id", "source", "size", "key").agg(
        F.collect_list("words").alias("__words")), "taken")
    side = small_side(taken.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"),
                                   F.col("key").alias("__k"), "__words"), F.lit(96))
    # Equal rows share one list: one of them stands for all.
    keyed = one_of_each(docs.withColumn("__key", mixing.row_key(F.col("doc_id"), F.col("text"))), ["__key", "doc_id", "source"])
    copies = keyed.join(side, (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d"))
                        & F.col("source").eqNullSafe(F.col("__s")))
    whole = copies.withColumn("__take", F.explode("__words"))
    first = lambda parts: F.slice(parts, 1, F.col("__take").cast("int"))
    # The words with what stands before each.
    cut = F.array_join(F.zip_with(first(F.split("text", WORD, -1)), first(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))),
                                  lambda space, word: F.concat(space, word)), "")
    text = F.when(F.col("__take") < F.col("__n"), cut).otherwise(F.col("text"))
    return whole.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences: every row's ids, those of a null text being the end id alone."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("private_data", replace_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Hash functions, a fitted model and permutations have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
