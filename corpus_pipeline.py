"""A corpus in five stages: quality, near duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm import bpe, jaccard_join, langid, mixing, pii, quality
from panelcast.llm.util import fresh, join_hot, may_be_in, stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; learnt from the labels whose remainder by 5 is not 0.

    A null text is judged as an empty one; equal texts fare alike, so repeated rows do.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(langid.remainder(F.col("doc_id"), 5) != 0)
    model = quality.fit(docs, labels)
    return docs.where(quality.score(model, F.col("text"), docs) >= quality.CUT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word Jaccard >= 0.8 connect: the one of the smallest doc_id.

    Rows are told apart by doc_id and text, so rows that repeat a doc_id with other
    texts are documents of their own, and a null doc_id comes after all others. Of rows
    equal in both one stays, the first by all columns. Texts without words all stay.
    """
    key, nth = fresh("_text_key", docs.columns), fresh("_nth", docs.columns)
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = jaccard_join.linked_rows(keyed, ["doc_id", key], k=5, num=80, den=100).where("comp IS NOT NULL")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col(key).alias("key"))
    rows = stage(rows.groupBy("comp", "doc_id", key).agg(F.count("*").alias("n")).select("comp", row.alias("row"), "n"), "groups")
    first = stage(rows.groupBy("comp").agg(F.min("row").alias("first"), F.count("*").alias("size")).where("size > 1"), "firsts")
    found = join_hot(rows, first, "comp").select("row.*", "n", F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("stays"))
    found = stage(found.where("NOT stays OR n > 1").select("doc_id", F.col("key").alias(key), "stays"), "gone")

    def joined(d: DataFrame, f: DataFrame, how: str) -> DataFrame:
        return d.join(f, d["doc_id"].eqNullSafe(f["doc_id"]) & (d[key] == f[key]), how)

    # only texts that may have to go, or stay once, are shuffled
    sought = may_be_in(found, "doc_id", key)(F.col("doc_id"), F.col(key))
    rest, keyed = keyed.where(~sought).select(docs.columns), keyed.where(sought)
    kept, again = joined(keyed, found.where("NOT stays"), "left_anti"), found.where("stays")
    if not again.limit(1).count():
        return rest.unionByName(kept.select(docs.columns))
    order = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    first = joined(keyed, again, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(order))).where(F.col(nth) == 1)
    return rest.unionByName(joined(kept, again, "left_anti").select(docs.columns)).unionByName(first.select(docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by surrogates; n_chars follows the text.

    A null text stays null and keeps its n_chars; every row stays, repeated ones alike.
    """
    out = pii.checked(docs, entities_col=fresh("pii_entities", docs.columns))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, or up to three times.

    A null source is a source of its own; rows equal in source, doc_id and text are
    interchangeable; texts without words are taken floor(target / size) times.
    """
    return mixing.mixture(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, decoded again: counts and digests, one row for each row; a null text is empty."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", replace_personal_data),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: No SQL: classifier, surrogates and merges are beyond it. Tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read again. No rows give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, f) in enumerate(STAGES):
        docs = stage(f(spark, docs, sf_dir), f"stage-{n}")
    return docs
