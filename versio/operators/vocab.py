"""Word vocabularies: token counts on the training split, frequency-ranked
ids after the four specials, size per language, storage."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import pre_tokenize
from ..schemas import FIRST_WORD_ID, MIN_FREQUENCY, SPECIAL_TOKENS, VOCAB, VOCAB_CAP
from .partitioning import spread_rows


def word_counts(df: DataFrame, texts: dict, partitions: int | None = None) -> DataFrame:
    """Token frequencies per language: ``(lang, token, count)``.

    ``texts`` maps a language name to its text column (name or Column).
    All languages go through one explode and one aggregation; frequent
    tokens collapse in the map-side partial aggregate before the shuffle.
    """
    parts = [F.struct(F.lit(lang).alias("lang"),
                      (F.col(c) if isinstance(c, str) else c).alias("text"))
             for lang, c in texts.items()]
    tokens = spread_rows(df, partitions).select(F.explode(F.array(*parts)).alias("_t")).select(
        F.col("_t.lang").alias("lang"), F.explode(pre_tokenize("_t.text")).alias("token"))
    return tokens.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("count"))


def word_counts_by_column(df: DataFrame, text_col: str, lang_col: str, partitions: int | None = None) -> DataFrame:
    """``(lang, token, count)`` where each row names its own language."""
    tokens = spread_rows(df, partitions).select(F.col(lang_col).alias("lang"), F.explode(pre_tokenize(text_col)).alias("token"))
    return tokens.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("count"))


def specials(spark: SparkSession, langs) -> DataFrame:
    """The four special tokens with ids 0..3 for every language."""
    rows = [(lang, tok, i) for lang in langs for i, tok in enumerate(SPECIAL_TOKENS)]
    return spark.createDataFrame(rows, VOCAB)


def _count_threshold(candidates: DataFrame, words: int) -> DataFrame:
    """``(lang, thr)``: the largest count value that at least ``words``
    candidates of the language reach. Only tokens counted ``>= thr`` can be
    among the first ``words`` (count desc), so filtering on it is exact. It
    is read from a histogram of count values (one row per distinct count),
    not from the tokens."""
    hist = candidates.groupBy("lang", "count").agg(F.count(F.lit(1)).alias("_n"))
    reach = Window.partitionBy("lang").orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_cum", F.sum("_n").over(reach))
    return cum.where(F.col("_cum") >= words).groupBy("lang").agg(F.max("count").alias("_thr"))


def build_vocab(counts: DataFrame, langs, cap: int = VOCAB_CAP,
                min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """``(lang, token, id)``: specials 0..3, then words seen at least
    ``min_frequency`` times by count desc, token asc, total capped at ``cap``.

    Candidates are first cut at the count threshold the cap needs (exact,
    see ``_count_threshold``; one row per language, broadcast). What remains
    per language is the cap plus the ties at the threshold (or fewer
    candidates than the cap when no cut is needed), so one window per
    language numbers them. The result has a proven size bound for
    broadcasting.
    """
    words = cap - len(SPECIAL_TOKENS)
    order = [F.col("count").desc(), F.col("token").asc()]
    candidates = counts.where(F.col("lang").isin(list(langs)) & (F.col("count") >= min_frequency))
    thr = _count_threshold(candidates, words)
    kept = candidates.join(F.broadcast(thr), "lang", "left").where(
        F.col("_thr").isNull() | (F.col("count") >= F.col("_thr")))
    numbered = kept.withColumn("_rn", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    top = numbered.where(F.col("_rn") <= words).select(
        "lang", "token", (F.col("_rn") + (FIRST_WORD_ID - 1)).cast("int").alias("id"))
    return specials(counts.sparkSession, langs).unionByName(top)


def train_vocab(split_df: DataFrame, langs: dict, cap: int = VOCAB_CAP,
                min_frequency: int = MIN_FREQUENCY, split: str = "train") -> DataFrame:
    """Vocabularies trained on one split only; ``langs`` maps language → text column."""
    rows = split_df.where(F.col("split") == split)
    return build_vocab(word_counts(rows, langs), list(langs), cap, min_frequency)


def materialize_vocab(vocab: DataFrame, langs, cap: int = VOCAB_CAP) -> DataFrame:
    """Compute a vocabulary once and keep it as a local relation, so the
    lookups, the manifest and the decoder do not each recount the corpus.
    Bounded by construction (≤ ``cap`` rows per language); checked here."""
    rows = vocab.select("lang", "token", "id").limit(cap * len(langs) + 1).collect()
    if len(rows) > cap * len(langs):
        raise ValueError(f"vocabulary has more rows than the bound {cap * len(langs)}")
    return vocab.sparkSession.createDataFrame(rows, VOCAB)


def vocab_size(vocab: DataFrame) -> DataFrame:
    """Entries per language, specials included."""
    return vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("vocab_size"))


def bounded(vocab: DataFrame, cap: int) -> DataFrame:
    """``vocab`` with a broadcast hint if it is seen to have at most ``cap``
    rows; a larger one is left to a shuffle join."""
    return F.broadcast(vocab) if vocab.limit(cap + 1).count() <= cap else vocab


def token_to_id(df: DataFrame, token_col: str, vocab: DataFrame, lang: str,
                out_col: str = "token_id", cap: int = VOCAB_CAP) -> DataFrame:
    """Lookup by token; unknown tokens get ``[UNK]`` = 0. A vocabulary of at
    most ``cap`` entries is broadcast."""
    v = vocab.where(F.col("lang") == lang).select(F.col("token").alias(token_col), F.col("id").alias(out_col))
    return df.join(bounded(v, cap), token_col, "left").withColumn(
        out_col, F.coalesce(F.col(out_col), F.lit(0)))


def id_to_token(df: DataFrame, id_col: str, vocab: DataFrame, lang: str,
                out_col: str = "token", cap: int = VOCAB_CAP) -> DataFrame:
    """Lookup by id; ids outside the vocabulary give a null token. A vocabulary
    of at most ``cap`` entries is broadcast."""
    v = vocab.where(F.col("lang") == lang).select(F.col("id").alias(id_col), F.col("token").alias(out_col))
    return df.join(bounded(v, cap), id_col, "left")


def save_vocab(vocab: DataFrame, path: str) -> None:
    """Store a vocabulary table; an existing folder is never overwritten."""
    vocab.write.mode("errorifexists").parquet(path)


def load_vocab(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Read a stored vocabulary and check its size bound before anyone
    broadcasts it (one count over a table of at most cap × languages rows)."""
    vocab = spark.read.schema(VOCAB).parquet(path)
    if max_rows is not None:
        n = vocab.count()
        if n > max_rows:
            raise ValueError(f"vocabulary at {path} has {n} rows, above the bound {max_rows}")
    return vocab


def load_or_train_vocab(spark: SparkSession, path: str, split_df: DataFrame, langs: dict,
                        cap: int = VOCAB_CAP) -> DataFrame:
    """Reuse the stored vocabulary when its write was completed, else train and
    store it; what a failed write left behind is replaced. A completed folder
    without the special tokens of every language is an error."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        vocab = load_vocab(spark, path, max_rows=cap * len(langs))
        found = vocab.where(F.col("id") < len(SPECIAL_TOKENS)).groupBy("lang").count().collect()  # one row per language
        if not set(langs) <= {r["lang"] for r in found if r["count"] == len(SPECIAL_TOKENS)}:
            raise ValueError(f"vocabulary at {path} lacks special tokens")
        return vocab
    if fs.exists(jvm_path):
        fs.delete(jvm_path, True)
    vocab = train_vocab(split_df, langs, cap)
    save_vocab(vocab, path)
    return load_vocab(spark, path)
