"""From documents to token ids in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, mixing, pieces, secrets, simhash
from lodestar.llm.common import drop_tables, materialize, read_table, table_mark
from lodestar.llm.queries import tokenizer_file, tokenizer_pattern

#: A text whose cosine with the nearest language prototype is below this is no text in a known language.
LEAST_COSINE = 0.2


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns renamed that are called (in any case) like one an operator adds, and the name under which each column is found."""
    place = {c: f"_aside_{i}" if c.lower() in names else c for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in place.items()]), place


def _back(rows: DataFrame, place: dict[str, str]) -> DataFrame:
    """The columns that ``_aside`` was given, under their names again."""
    return rows.select(*[F.col(f"`{n}`").alias(c) for c, n in place.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or unlike every learned language; ``lang`` becomes the predicted one where it was null."""
    rows, place = _aside(docs, "held_out", "lang_pred", "score", "cosine")
    found = langid.identify(rows)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("cosine") >= LEAST_COSINE))
    return _back(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), place)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five-word shingles, similarity 0.8): that with the smallest id, rows without an id last.

    Groups are of texts, not of ids: different texts that share an id, or have none, are judged each for
    itself. Of rows that are alike in id and text, the first by all their columns stays.
    """
    groups = simhash.near_copies(docs.select("doc_id", "text"), width=5, similarity=0.8)
    keys = groups.groupBy("group", "doc_id", "text_key").count()
    first = keys.groupBy("group").agg(F.min_by(F.struct("doc_id", "text_key", "count"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("x"))
    first = materialize(first.select(F.col("x.doc_id").alias("_first_id"), F.col("x.text_key").alias("_first_key"), F.col("x.count").alias("_first_n")), "firsts")
    keyed = docs.select("*", simhash.text_key().alias("_first_at"))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("_first_id")) & (F.col("_first_at") == F.col("_first_key")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    single = kept.where("_first_n = 1").select(*own)
    if first.where("_first_n > 1").isEmpty():
        return single
    whole = F.struct(*own)
    one = kept.where("_first_n > 1").groupBy("_first_id", "_first_key").agg(F.min_by(whole, F.to_json(whole)).alias("_row"))
    return single.unionByName(one.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found by its kind in brackets; no document is dropped."""
    return secrets.redacted(docs, tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their target weights."""
    rows, place = _aside(docs, "size", "source_size", "target", "times", "taken", "copy")
    return _back(mixing.repeat(mixing.mix(rows)), place)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: one row per document taken, repeats included."""
    return pieces.digests(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Language prototypes and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage read and wrote on its way goes once its result is written."""
    docs, mark = read_table(spark, sf_dir, "documents"), table_mark()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_tables(spark, mark, keep=1)
    return docs
