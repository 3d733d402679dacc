"""A training corpus in five stages: language, repeated lines, near-duplicates, benchmark leaks, token ids.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir), where ``docs`` has the
columns of the table ``documents`` (others are kept, too), and returns a DataFrame. The first four
return those columns. Each stage's rows are written as Parquet and read again as the next stage's
``docs``, so a lost executor costs a part of one stage.

Defined cases are those of the operators; here they mean: a null text or one without a letter goes in
the first stage; documents with null ids are kept as long as their text is; of rows that repeat,
near-duplicate removal keeps one, and of two unrelated texts with one id both; very long texts go through every stage whole;
of near-duplicates that tie, the smallest id stays; empty tables give empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontaminate, language, line_dedup, minhash
from ledgerlens.llm.common import pack, remove_staged, staged, staged_paths, table

#: Texts with a smaller score go. Margins alone give 0.25 or more where a language wins its pairs, so it is
#: the fit (1 for a text like those learned from) that takes texts of no learned language below it.
LEAST_SCORE = 0.2


#: Rows of an Arrow batch: whole texts are large rows, and batches of them fill memory beside the heap.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def _small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches from now on, unless the session has a setting of its own (other than Spark's default)."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the documents' labels; texts without a letter, or of no clear language, go."""
    _small_batches(spark)
    found = language.identify(docs, language.train(docs, F.lit(True)))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut from the texts; a text that loses all its lines goes.

    A column ``n_chars`` follows its text.
    """
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(F.col("row.n_chars")))
    cut = line_dedup.dedup_lines(docs)
    return cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).select(row.alias("row")).select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 over five-word shingles, the smallest id stays."""
    _small_batches(spark)
    return minhash.one_of_each(docs, shingle=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with an item of the table ``benchmark`` go."""
    leaks = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("id").alias("_id"), F.col("k").alias("_k")).distinct()
    base = pack(docs).drop("text")
    return base.join(leaks, (F.col("k") == F.col("_k")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti").select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its id, the token ids, and the text that they decode to."""
    _small_batches(spark)
    tokens = bpe.encode(docs.select("doc_id", "text"))
    return tokens.select("row.doc_id", F.col("ids").alias("token_ids"), F.size("ids").cast("long").alias("n_tokens"),
                         F.col("decoded").alias("text"))


STAGES = [
    ("language", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table ``documents``. What a stage has staged goes once its result is written, and that
    once the next one's is; the last result stays."""
    docs, before = table(spark, sf_dir, "documents"), staged_paths(spark)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove_staged(spark, [p for p in staged_paths(spark)[:-1] if p not in before])
    return docs


#: Language identification learns; SQL can't express it.
ORACLE_SQL = None
