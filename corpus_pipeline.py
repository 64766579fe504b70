"""Raw documents to token ids: language ID, near-dedup, repeated passages, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all documents that it gets, and returns a DataFrame; all but the last
return the columns of documents. Null texts and empty tables pass through every stage as its operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import stored, table
from recspark.llm.decontaminate import clean
from recspark.llm.language_id import UNDETERMINED, fit, identify
from recspark.llm.near_copies import SAME_TEXT, groups
from recspark.llm.repeats import remove_repeats
from recspark.llm.sentencepiece_codec import MODEL, encode

# A document goes if no language is more probable than this.
LEAST_POSTERIOR = 0.5


# The columns that stages read; all others are carried along under names that no operator uses.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with its further columns renamed, and the way back to exactly its columns."""
    names = [c if c in READ else f"_carried{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or without a probable language, go. An unknown lang becomes the predicted one.

    Null and empty texts go; repeated rows and null ids are judged alike, row by row; further columns keep their values,
    whatever their names; an empty table stays empty.
    """
    docs, back = _aside(docs)
    scored = identify(docs, fit(docs))
    kept = scored.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_POSTERIOR))
    return back(kept.withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, of its texts that with the smallest hash.

    A group is what op8's fingerprints or a five-word Jaccard of 0.8 or more link. Null ids come last, so of a group
    without an id one row stays too. Of rows equal in id and text the one whose JSON text is smallest stays. Texts without
    words, null ones too, are one group. Further columns keep their values, whatever their names.
    """
    docs, back = _aside(docs)
    marked, roots = groups(docs)
    placed = stored(marked.join(roots, "node").groupBy("root", "doc_id", "same").agg(F.count("*").alias("n")))
    keep = stored(placed.groupBy("root").agg(F.expr("min(struct(doc_id is null as unnamed, doc_id as id, same, n)) as one")).select("one.id", "one.same", "one.n"))

    def kept(which: str) -> DataFrame:
        some = keep.where(which)
        return docs.join(some, docs.doc_id.eqNullSafe(some.id) & (F.expr(SAME_TEXT) == some.same), "left_semi")

    row = F.struct(*docs.columns)
    repeated = kept("n > 1").groupBy("doc_id", F.expr(SAME_TEXT)).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return back(kept("n = 1").unionByName(repeated))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 400 bytes that occur elsewhere too; every document stays.

    Characters cut in the middle are left out of the text; a null text becomes an empty one. Repeated rows repeat each
    other. Further columns keep their values, whatever their names; an empty table stays empty.
    """
    docs, back = _aside(docs)
    cut = remove_repeats(docs)
    return back(cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs.

    Null and empty texts stay; repeated rows and null ids are judged alike; further columns keep their values, whatever
    their names; an empty table stays empty.
    """
    docs, back = _aside(docs)
    return back(clean(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it. A null text counts as empty; repeated rows stay."""
    import public_tokenizers

    docs, _ = _aside(docs)
    coded = encode(docs, public_tokenizers.path(MODEL), back=True)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", tokens),
]

# Hash fingerprints, suffix ranges and merges have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
